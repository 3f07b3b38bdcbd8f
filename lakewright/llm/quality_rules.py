"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much go.

Everything here is built of Spark's own expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, aside, columns_of

# Signs counted as symbols, and phrases of licence, consent and navigation lines.
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "this work is licensed", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "click here", "subscribe to our", "sign up for", "follow us on", "powered by",
)
MENU = ("home", "about", "contact", "login", "log in", "sign in", "sign up", "register", "menu", "next", "previous", "back to top", "share", "search", "faq", "sitemap", "read more")

#: A line fails with this many punctuation marks or symbols for each 100 words (beyond single sentence ends) ...
MARKS_PER_100 = 30
#: ... a document goes when its failing lines held more than this percentage of its words.
LOSS_PERCENT = 50
MIN_WORDS, REPEAT_PERCENT = 10, 20


def words_of(text: str) -> str:
    return f"array_remove(split({text}, '{_q(WORD_SPLIT)}', -1), '')"


def _q(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates value once for all uses of name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """How many words lie in a 5-word window that the array of words holds twice or more. Linear but for two sorts."""
    window = ", ".join(f"w[i + {k}]" for k in range(5))
    covered = "aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + if(k = size(p) - 1, 5, least(5, p[k + 1] - p[k])))"
    doubled = "filter(transform(s, (e, k) -> if((k > 0 and s[greatest(k - 1, 0)].v = e.v) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].v = e.v), e.i, -1)), i -> i >= 0)"
    heavy = let("s", "sort_array(transform(h, (v, i) -> struct(v, i)))", let("p", f"sort_array({doubled})", covered))
    some = let("h", f"transform(sequence(0, size(w) - 5), i -> xxhash64({window}))", f"if(size(array_distinct(h)) = size(h), 0L, {heavy})")
    return let("w", words, f"if(size(w) < 6, 0L, {some})")


def line_verdicts(text: str) -> str:
    """SQL text: for each line, struct(line, n words, failed rule or null)."""
    rules = {
        "boilerplate": f"low rlike '{'|'.join(BOILERPLATE)}'",
        "navigation": "n <= 12 and low rlike '^[\\\\s|>»·-]*(?:" + "|".join(MENU) + ")(?:[\\\\s|>»·,-]+(?:" + "|".join(MENU) + "))*[\\\\s|>»·.-]*$'",
        "separators": "5 * regexp_count(l, '[|»›·•]') >= n and regexp_count(l, '[|»›·•]') >= 2",
        "punctuation": f"100 * regexp_count(l, '[#*$%&|<>]+|[!?]{{2,}}|[~^=_]{{3,}}') >= {MARKS_PER_100} * n and n >= 3",
        "capitals": "n >= 5 and l = upper(l) and l <> low",
        "one word over": "n >= 8 and 5 * size(array_distinct(w)) < n",
    }
    case = "case when n = 0 then null " + " ".join(f"when {rule} then '{name}'" for name, rule in rules.items()) + " end"
    body = let("w", words_of("l"), let("low", "lower(l)", let("n", "size(w)", f"struct(l as line, n as n, {case} as rule)")))
    return f"transform(split({text}, '\\n', -1), l -> {body})"


def assess(docs: DataFrame, text_col: str = "text", loss_percent: int = LOSS_PERCENT) -> DataFrame:
    """docs with a column `quality`: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), lost_words (long), failed_lines (int), clean_text.

    A null or empty text has no words, fails the base and is not kept; its clean_text is empty. Each row is
    judged by itself: repeated rows and ties get equal verdicts, an empty table gives an empty one, and other
    columns pass through (a column that is named quality already is replaced). A text of any length is judged whole.
    """
    t = "_t"
    docs, back = aside(docs.drop("quality"), t, "_w", "_l")
    out = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns({"_w": F.expr(words_of(t)), "_l": F.expr(line_verdicts(t))})
    worded = "transform(filter(_l, x -> x.n > 0), x -> x.line)"
    lost = F.expr("aggregate(_l, 0L, (n, x) -> n + if(x.rule is null, 0, x.n))")
    n = F.size("_w").cast("long")
    base = {
        "n_words": n,
        "word_chars": F.expr("cast(char_length(array_join(_w, '')) as long)"),
        "n_symbols": F.expr(f"cast(regexp_count({t}, '{SYMBOLS}') as long)"),
        "n_dup_lines": F.expr(let("x", worded, "cast(size(x) - size(array_distinct(x)) as long)")),
        "n_repeat_words": F.expr(repeat_words("_w")).cast("long"),
        "lost_words": lost,
        "failed_lines": F.expr("size(filter(_l, x -> x.rule is not null))"),
        "clean_text": F.expr("array_join(transform(filter(_l, x -> x.rule is null), x -> x.line), '\\n')"),
    }
    out = out.withColumn("quality", F.struct(*[c.alias(k) for k, c in base.items()])).drop("_w", "_l", t)
    q = lambda k: F.col("quality")[k]
    failed = (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > REPEAT_PERCENT * q("n_words"))
    kept = ~failed & (100 * q("lost_words") <= loss_percent * q("n_words"))
    return back(out.withColumn("quality", F.col("quality").withField("base_failed", failed).withField("kept", kept)))


def clean(docs: DataFrame, text_col: str = "text", loss_percent: int = LOSS_PERCENT) -> DataFrame:
    """The documents kept, without their failing lines; same columns as docs (n_chars follows the text where there is one).

    Nulls, blanks, repeated rows, clashing names and empty tables are as in assess().
    """
    own, back = aside(docs, "quality", "_place")
    # A column that is not a function of the row keeps the optimizer from evaluating the rules in a filter and once more behind it.
    judged = assess(own, text_col, loss_percent).withColumn("_place", F.monotonically_increasing_id())
    kept = judged.where(F.col("quality.kept") & (F.col("_place") >= 0))
    kept = back(kept.withColumn(text_col, F.col("quality.clean_text")).drop("quality", "_place"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return columns_of(kept, docs)
