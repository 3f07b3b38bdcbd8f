"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates come from regular expressions. Pattern, gazetteer and context labelers vote for (1), against (-1)
or not at all (0) on each. How often each combination of votes occurs is counted over all documents (at most
3^4 combinations a kind reach the driver); expectation-maximisation on those counts estimates each labeler's
reliability and each combination's posterior, and a logistic span classifier is trained on them. Its weights
become a Spark expression: the main path has neither Python functions nor RDDs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, columns_of, staged
from .quality_rules import _q, let

# The kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national", "secret")

# What the gazetteer labeler knows.
GAZETTEER = {
    "email": r"[@.](?:gmail|yahoo|hotmail|outlook|example|mail[0-9]*)\.|\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "ip": r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "national": r"^\(?(?:0|1?[2-9][0-9]{2})",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk_|sk-|xox|AIza|eyJ)",
}
# Words before a span that speak for a kind, and those that speak against any.
NEAR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip|addr|address|host|server|from|login)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment|pay)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|cell|fax)\W*(?:\w+\W+){0,2}$",
    "national": r"(?i)(?:tel|phone|call|mobile|cell|fax)\W*(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credential|auth)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|item|sku|ver|commit|checksum|sha|md5)\W*(?:\w+\W+){0,1}$"
CONTEXT_CHARS, THRESHOLD, ROUNDS = 40, 0.5, 50
#: The posterior that a candidate needs which its own pattern labeler votes against.
STRICT = 0.95

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A sign that joins parts while a pattern runs; the text's own signs of this kind become one that no pattern knows.
_MARK, _FOREIGN = "\\u0001", "\\u0002"
#: Running totals are taken in blocks of 2^8.
_BLOCK_BITS = 8


def _running(values: str, total: str, start: str, step: str, body: str) -> str:
    """SQL text: body, in which total(k) stands for the running total of the array `values` up to position k, itself included.

    step: SQL text of (s, x) -> total. Totals of blocks come first, so the work grows with the number of values, not its square.
    """
    size = 1 << _BLOCK_BITS
    fold = lambda part: f"aggregate({part}, {start}, (s, x) -> {step})"
    blocks = f"transform(sequence(0, shiftright(size(vs) - 1, {_BLOCK_BITS})), b -> {fold(f'slice(vs, b * {size} + 1, {size})')})"
    before = f"transform(bs, (y, b) -> {fold('slice(bs, 1, b)')})"
    up_to = f"aggregate(slice(vs, shiftright(k, {_BLOCK_BITS}) * {size} + 1, k % {size} + 1), pre[shiftright(k, {_BLOCK_BITS})], (s, x) -> {step})"
    return let("vs", values, let("bs", blocks, let("pre", before, let(total, f"transform(vs, (v, k) -> {up_to})", body))))


def _match(pattern: str, kind: str, text: str) -> str:
    """SQL text: array of struct(kind, start, stop, b0, b1) of a pattern's leftmost matches; one pass for gaps, one for matches.

    start and stop count code points, b0 and b1 bytes. A pass over the text and running totals: linear in text and matches.
    """
    ends = lambda f, total, body: _running(f"transform(m, (x, k) -> {f}(g[k]) + {f}(x))", total, "0", "s + x", body)
    row = f"struct('{kind}' as kind, ce[k] - char_length(x) as start, ce[k] as stop, be[k] - octet_length(x) as b0, be[k] as b1)"
    rows = ends("char_length", "ce", ends("octet_length", "be", f"transform(m, (x, k) -> {row})"))
    return let("m", f"regexp_extract_all({text}, '{_q(pattern)}', 0)", f"if(size(m) = 0, {_none()}, " + let("g", f"split({text}, '{_q(pattern)}', -1)", rows) + ")")


def _none() -> str:
    return "cast(array() as array<struct<kind: string, start: int, stop: int, b0: int, b1: int>>)"


def _found(text: str) -> str:
    """SQL text: all candidates of a text.

    Repeated groups would overflow the stack on very long runs. So a sign that joins two parts is first
    replaced by one mark (lengths stay), after which each kind is a run over one class of characters.
    """
    safe = f"translate({text}, '{_MARK}', '{_FOREIGN}')"
    dotted = f"regexp_replace({safe}, '{_q(r'\.(?=[A-Za-z0-9-])')}', '{_MARK}')"
    joined = f"regexp_replace({safe}, '{_q(r'(?<=[0-9])[ -](?=[0-9])')}', '{_MARK}')"
    local = r"A-Za-z0-9._%+\x01-"
    parts = {
        "email": (f"contains({text}, '@')", dotted, rf"(?:(?<![{local}])|\G)[{local}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"),
        "ip": (f"{text} rlike '{_q(r'[0-9]\.[0-9]{1,9}\.[0-9]{1,9}\.[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]')}'", text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (f"{text} rlike '[0-9][0-9 -]{{11,}}[0-9]'", joined, r"[0-9][0-9\x01]{12,}"),
        "phone": (f"{text} rlike '{_q(r'\+[0-9]')}'", text, r"\+[0-9][ ().0-9-]+[0-9]"),
        "national": (f"{text} rlike '[0-9][ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}|[)][ ]?[0-9]{{3}}[ -][0-9]{{4}}'", text, r"(?<![+0-9().-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
        "secret": (f"{text} rlike '[A-Za-z0-9_=]{{16}}'", text, r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}"),
    }
    return "concat(" + ", ".join(f"if({guard}, {_match(p, kind, t)}, {_none()})" for kind, (guard, t, p) in parts.items()) + ")"


def _luhn(digits: str) -> str:
    """SQL text: whether a string of digits passes the Luhn check."""
    d = "cast(substring(z, size_z - k, 1) as int)"
    part = f"if(k % 2 = 1, if(2 * {d} > 9, 2 * {d} - 9, 2 * {d}), {d})"
    return let("z", digits, let("size_z", "char_length(z)", f"aggregate(sequence(0, size_z - 1), 0, (n, k) -> n + {part}) % 10 = 0"))


def _valid(kind: str, v: str) -> str:
    """SQL text: whether a candidate's value passes its kind's own check."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"{v} rlike '^{_q(_OCTET)}(?:{_q(chr(92) + '.' + _OCTET)}){{3}}$'",
        "card": f"if(char_length({digits}) between 13 and 19, {_luhn(digits)}, false)",
        "phone": f"char_length({digits}) between 9 and 15",
        "national": f"char_length({digits}) between 9 and 11",
        "secret": f"({v} rlike '[0-9]' and {v} rlike '[A-Za-z]' and char_length(regexp_replace({v}, '[^0-9]', '')) >= 2)",
    }[kind]


def candidates(text: str = "_t") -> str:
    """SQL text: array of struct(kind, start, stop, b0, b1, base, v1..v4): votes by pattern, gazetteer, context and shape.

    Values and contexts are cut from the text's bytes, which needs no pass over what lies before them.
    """
    of = lambda f: "case c.kind " + " ".join(f"when '{k}' then {f(k)}" for k in KINDS) + " end"
    value = "cast(substring(tb, c.b0 + 1, c.b1 - c.b0) as string)"
    left = f"right(cast(substring(tb, greatest(c.b0 - {4 * CONTEXT_CHARS}, 0) + 1, least(c.b0, {4 * CONTEXT_CHARS})) as string), {CONTEXT_CHARS})"
    right = "left(cast(substring(tb, c.b1 + 1, 4) as string), 1)"
    votes = (
        "if(good, 1, -1)",
        f"if({of(lambda k: f"v rlike '{_q(GAZETTEER[k])}'")}, 1, 0)",
        f"case when l rlike '{_q(AGAINST)}' then -1 when {of(lambda k: f"l rlike '{_q(NEAR[k])}'")} then 1 else 0 end",
        "if(l rlike '[A-Za-z0-9@_]$' or r rlike '^[A-Za-z0-9@_]', -1, 1)",
    )
    row = f"struct(c.kind as kind, c.start as start, c.stop as stop, c.b0 as b0, c.b1 as b1, c.kind in ({', '.join(repr(k) for k in BASE)}) and good as base, {', '.join(f'{x} as v{i}' for i, x in enumerate(votes, 1))})"
    body = let("v", value, let("l", left, let("r", right, let("good", of(lambda k: _valid(k, "v")), row))))
    return let("cs", _found(text), f"if(size(cs) = 0, cast(array() as {_CANDIDATES}), " + let("tb", f"cast({text} as binary)", f"transform(cs, c -> {body})") + ")")


_CANDIDATES = "array<struct<kind: string, start: int, stop: int, b0: int, b1: int, base: boolean, v1: int, v2: int, v3: int, v4: int>>"


def _with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    out = docs.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return out.withColumn("_c", F.expr(candidates("_t"))).drop("_t")


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    """Weights (bias, v1..v4) of each kind's span classifier, from the votes on all candidates of all documents."""
    return _weights(_with_candidates(docs.select(text_col), text_col))


def _weights(found: DataFrame) -> dict[str, list[float]]:
    votes = found.select(F.explode("_c").alias("c")).groupBy("c.kind", "c.v1", "c.v2", "c.v3", "c.v4").count()
    seen: dict[str, list[tuple[tuple[int, ...], int]]] = {}
    for kind, *v, n in votes.collect():  # at most 3^4 rows a kind
        seen.setdefault(kind, []).append((tuple(v), n))
    return {kind: _classifier(_posteriors(sorted(rows))) for kind, rows in sorted(seen.items())}


def _posteriors(rows: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], float, float]]:
    """Two classes, labelers independent within each: (votes, count, posterior) by expectation-maximisation."""
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in rows]
    for _ in range(ROUNDS):
        total = [1.0 + sum(n * (p if c else 1 - p) for (_, n), p in zip(rows, post, strict=True)) for c in (0, 1)]
        rate = [[{x: 0.5 + (1.5 if x == (1 if c else -1) else 0) for x in (-1, 0, 1)} for _ in range(4)] for c in (0, 1)]
        for (v, n), p in zip(rows, post, strict=True):
            for c in (0, 1):
                for k, x in enumerate(v):
                    rate[c][k][x] += n * (p if c else 1 - p)
        new = []
        for v, _ in rows:
            score = [math.log(total[c]) + sum(math.log(rate[c][k][x] / sum(rate[c][k].values())) for k, x in enumerate(v)) for c in (0, 1)]
            new.append(1 / (1 + math.exp(max(-500.0, min(500.0, score[0] - score[1])))))
        post = new
    return [(v, n, p) for (v, n), p in zip(rows, post, strict=True)]


def _classifier(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression of the posteriors on the votes, by gradient descent over the counted combinations."""
    w, total = [0.0] * 5, sum(n for _, n, _ in rows)
    for _ in range(steps):
        slope = [decay * x for x in w]
        for v, n, p in rows:
            x = (1, *v)
            miss = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - p
            slope = [s + n / total * miss * b for s, b in zip(slope, x, strict=True)]
        w = [a - rate * s for a, s in zip(w, slope, strict=True)]
    return w


def _accepted(weights: dict[str, list[float]]) -> str:
    """SQL text: whether a candidate is a span: a base one that passes its check, or one that the classifier accepts."""
    score = "case c.kind " + "".join(f"when '{k}' then {w[0]:.6f}D + " + " + ".join(f"({x:.6f}D) * c.v{i}" for i, x in enumerate(w[1:], 1)) + " " for k, w in weights.items()) + "else -1000D end" if weights else "-1000D"
    logit = lambda p: math.log(p / (1 - p))
    return f"c.base or {score} >= if(c.v1 = 1, {logit(THRESHOLD):.6f}D, {logit(STRICT):.6f}D)"


def annotate(docs: DataFrame, text_col: str = "text", weights: dict[str, list[float]] | None = None, keep_text: bool = True) -> DataFrame:
    """docs with `spans`: array of struct(kind, start, stop, base, b0, b1), by kind as listed in KINDS, then start.

    start and stop are code points, b0 and b1 the same places in bytes; stop and b1 are exclusive. Spans of the base
    kinds that pass their checks always stay; the span classifier adds others (weights: from fit(), else fitted on
    docs, whose candidates are then found once and written to the shared folder). A null or empty text has no spans;
    the work grows with the length of a text and its matches. Rows are judged one by one, so repeated rows and ids get
    equal spans; an empty table stays empty; other columns pass through, but for one named spans, which is replaced,
    and for the text where it is not kept.
    """
    docs, back = aside(docs.drop("spans"), "_t", "_c")
    found = _with_candidates(docs, text_col)
    found = found if keep_text else found.drop(text_col)
    if weights is None:
        found = staged(found, "candidates")
        weights = _weights(found)
    order = ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS))
    kept = f"transform(sort_array(transform(filter(_c, c -> {_accepted(weights)}), c -> struct(map({order})[c.kind] as o, c.start as start, c.stop as stop, c.kind as kind, c.base as base, c.b0 as b0, c.b1 as b1))), c -> struct(c.kind, c.start, c.stop, c.base, c.b0, c.b1))"
    return back(found.withColumn("spans", F.expr(kept)).drop("_c"))


def listed(spans: str) -> str:
    """SQL text: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def masked(text_col: str = "text") -> Column:
    """The text with each span replaced by <KIND>; where spans overlap, the earlier (then longer) one stands for both."""
    t = f"cast(coalesce(cast(`{text_col}` as string), '') as binary)"
    by_start = "sort_array(transform(spans, s -> struct(s.b0 as b0, -s.b1 as back, s.kind as kind)))"
    piece = "if(k = 0 or z[k].b0 >= far[k - 1], concat(cast(substring(tb, if(k = 0, 0, far[k - 1]) + 1, z[k].b0 - if(k = 0, 0, far[k - 1])) as string), '<', upper(z[k].kind), '>'), '')"
    whole = f"concat(array_join(transform(z, (y, k) -> {piece}), ''), cast(substring(tb, far[size(z) - 1] + 1, octet_length(tb)) as string))"
    return F.expr(f"if(size(spans) = 0, `{text_col}`, " + let("tb", t, let("z", by_start, _running("transform(z, q -> -q.back)", "far", "0", "greatest(s, x)", whole))) + ")")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their personal data masked; same columns (n_chars follows the text where there is one)."""
    own, back = aside(docs, "spans")
    out = back(annotate(own, text_col).withColumn(text_col, masked(text_col)).drop("spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return columns_of(out, docs)
