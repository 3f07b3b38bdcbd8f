"""The engine: SQL text in, a Result out; DML on immutable Parquet snapshots with constraints and transactions.

A table is a list of Parquet folders; a change writes a new folder and a new version map. The map is written aside
and renamed to the next number, never over another (atomic where the store's rename is, as on HDFS), so a crash leaves
nothing half written, readers keep their snapshot, and a writer that lost a race is told so and has the newest state.
Queries go to Catalyst after rewriting: other dialects' spellings, nulls last, whole numbers divided as such, text search.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .functions import scalars
from .plans import dialect


class EngineError(Exception):
    """A statement that breaks a rule; it has changed nothing."""


class LostRace(EngineError):
    """Another session has committed first."""


@dataclass
class Result:
    frame: DataFrame | None = None
    rows_affected: int = 0
    last_insert_id: int | None = None
    message: str = ""


# SQL type names of other dialects, as Spark's types.
TYPES = {
    "int": "int", "integer": "int", "int4": "int", "smallint": "int", "tinyint": "int", "mediumint": "int", "bigint": "bigint", "int8": "bigint", "float": "double", "real": "double", "double": "double", "float4": "double", "float8": "double",
    "varchar": "string", "char": "string", "text": "string", "longtext": "string", "mediumtext": "string", "tinytext": "string", "string": "string", "enum": "string", "set": "string", "json": "string", "uuid": "string", "blob": "string", "boolean": "boolean", "bool": "boolean", "bit": "boolean",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "date": "date", "time": "int", "decimal": "decimal", "dec": "decimal", "numeric": "decimal", "binary": "binary", "varbinary": "binary",
}

_NAME = r"[`\"]?([\w#$]+)[`\"]?"


@dataclass
class Table:
    columns: dict[str, str]
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    keys: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[dict] = field(default_factory=list)
    auto: str | None = None
    next_id: int = 1
    partition: dict | None = None
    paths: list[str] = field(default_factory=list)
    external: str | None = None

    @property
    def kinds(self) -> dict[str, str]:
        return {c.lower(): k for c, k in self.columns.items()}


class Engine:
    """One session. folder: a URI on storage that the executors share. profile: "standard", or "compat" for lenient casts,
    matching and grouping blind to case, clamped substrings, nulls that spread through GREATEST and LEAST, whole ROUND."""

    def __init__(self, spark: SparkSession, folder: str, profile: str = "standard"):
        if profile not in ("standard", "compat"):
            raise EngineError(f"no profile {profile}")
        self.spark, self.folder, self.compat = spark, folder.rstrip("/"), profile == "compat"
        self.state: dict = {"tables": {}, "views": {}, "sequences": {}, "procedures": {}, "triggers": {}, "indexes": {}, "grants": []}
        self.local: dict[str, Table] = {}  # tables of this session alone
        self.version, self.open, self.savepoints = -1, None, []
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, dict] = {}
        self.last_id, self.depth = 0, 0
        self._load()

    # storage
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _load(self) -> None:
        found = self._versions()
        if found:
            self.version = found[-1]
            fs, p = self._fs(f"{self.folder}/versions/{self.version}.json")
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            self.state = json.loads(text)
            self.state["tables"] = {k: Table(**t) for k, t in self.state["tables"].items()}

    def reload(self) -> None:
        """Take up what other sessions have committed; not within a transaction."""
        if self.open is not None:
            raise EngineError("a transaction is open")
        self._load()

    def _commit(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        state = self.state | {"tables": {k: vars(t) for k, t in self.state["tables"].items()}}
        fs, aside = self._fs(f"{self.folder}/versions/open-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = self._fs(f"{self.folder}/versions/{self.version + 1}.json")
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over another session's file
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, final, kinds)
        except Exception as e:
            fs.delete(aside, False)
            self._load()
            raise LostRace("another session has committed meanwhile; this one has the newest state now") from e
        self.version += 1

    def _changed(self) -> None:
        if self.open is None:
            self._commit()

    def _schema(self, t: Table) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in t.columns.items()))

    def table(self, name: str, bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
        """A table's rows; bounds: of a range-partitioned one, only the partitions that hold keys from the first to the second."""
        t = self._table(name)
        if t.external:
            return self.spark.read.parquet(t.external)
        paths = t.paths if bounds is None or not t.partition else [p for p in t.paths if _part_meets(t.partition["bounds"], p, bounds)]
        if not paths:
            return self.spark.createDataFrame([], self._schema(t))
        return self.spark.read.schema(self._schema(t)).parquet(*paths)

    def _table(self, name: str) -> Table:
        name = name.lower()
        if name in self.local:
            return self.local[name]
        if name not in self.state["tables"]:
            raise EngineError(f"no table {name}")
        return self.state["tables"][name]

    def _write(self, t: Table, df: DataFrame, append: bool) -> None:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        df = df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in t.columns.items()))
        if not t.partition:
            df.write.parquet(path)
            t.paths = [*t.paths, path] if append else [path]
            return
        # a folder for each partition: reads and rewrites touch only those they need
        df.withColumn(_PART, _part_of(t.partition)).repartition(_PART).write.partitionBy(_PART).parquet(path)
        fs, p = self._fs(path)
        made = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{_PART}=")]
        t.paths = [*t.paths, *made] if append else made

    def import_frame(self, name: str, df: DataFrame) -> None:
        """A new table with the rows of df."""
        t = Table({f.name: f.dataType.simpleString() for f in df.schema.fields})
        self._write(t, df, False)
        self.state["tables"][name.lower()] = t
        self._changed()

    def attach(self, name: str, path: str) -> None:
        """A Parquet folder that stays where it is as a table of this session, for reading."""
        df = self.spark.read.parquet(path)
        self.local[name.lower()] = Table({f.name: f.dataType.simpleString() for f in df.schema.fields}, external=path)

    def _tables(self) -> dict[str, Table]:
        return self.state["tables"] | self.local

    def _kind(self, name: str) -> str | None:
        """The kind of a column of that name, if all tables that have one agree."""
        kinds = {t.kinds[name] for t in self._tables().values() if name in t.kinds}
        return kinds.pop() if len(kinds) == 1 else None

    def _register(self, sql: str | None = None) -> None:
        """Views of the tables and views that sql names, and of those that these views name; of all without sql."""
        names, todo = set(), [sql] if sql is not None else [f"{' '.join(self._tables())} {' '.join(self.state['views'])}"]
        while todo:
            for w in {x.text.strip("`").lower() for x in dialect.tokens(todo.pop()) if x.kind in ("word", "name")} - names:
                if w in self._tables() or w in self.state["views"] or w in _SCHEMA_VIEWS:
                    names.add(w)
                    todo += [self.state["views"][w]] if w in self.state["views"] else []
        for name in names & set(self._tables()):
            t = self._table(name)
            self.table(name, _asked(sql, t.partition["column"]) if sql and t.partition else None).createOrReplaceTempView(name)
        for name in names & set(_SCHEMA_VIEWS):
            _SCHEMA_VIEWS[name](self).createOrReplaceTempView(name)
        for name in self.state["views"]:  # in the order of their making: later ones may read earlier ones
            if name in names:
                self.spark.sql(self.state["views"][name]).createOrReplaceTempView(name)

    # statements
    def script(self, sql: str) -> list[Result]:
        return [self.execute(s) for s in dialect.statements(sql)]

    def sql(self, text: str) -> DataFrame:
        return self.execute(text).frame

    def execute(self, text: str) -> Result:
        raw = text.strip().rstrip(";")
        verbatim, back = dialect.mask(raw)
        for pattern, action in _VERBATIM:
            if m := re.match(pattern, verbatim, re.I | re.S):
                return self._undoing(action, [back(g) for g in m.groups()])
        masked, back = dialect.mask(dialect.rewrite(raw, dialect.Context(self.last_id, self._kind, self.compat)))
        for pattern, action in _STATEMENTS:
            if m := re.match(pattern, masked, re.I | re.S):
                return self._undoing(action, [back(g) for g in m.groups()])
        return self._query(back(masked))

    def _undoing(self, action, groups: list) -> Result:
        """A statement that fails has changed nothing; if it lost a race, the newest state holds."""
        before, local = copy.deepcopy(self.state), copy.deepcopy(self.local)
        try:
            return action(self, *groups) or Result(message="ok")
        except LostRace:
            raise
        except Exception:
            self.state, self.local = before, local
            raise

    def _query(self, sql: str) -> Result:
        asked = self._numbered(sql)
        if asked != sql:
            self._changed()
        self._register(asked)
        return Result(self.spark.sql(asked))

    def _numbered(self, sql: str) -> str:
        masked, back = dialect.mask(sql)
        return back(re.sub(r"\bNEXTVAL\s*\(\s*('[^']*')\s*\)", lambda m: str(self._nextval(back(m[1]).strip("'"))), masked, flags=re.I))

    def _nextval(self, name: str) -> int:
        s = self.state["sequences"].get(name.lower())
        if s is None:
            raise EngineError(f"no sequence {name}")
        s["value"] += s["step"]
        return s["value"] - s["step"]

    # definition
    def _create_table(self, temporary: str | None, ok: str | None, name: str, rest: str) -> Result:
        own = self.local if temporary or name.lower().startswith(dialect.TEMPORARY) else self.state["tables"]
        if name.lower() in own:
            if ok:
                return Result(message="exists")
            raise EngineError(f"{name} exists")
        body, tail = _parenthesised(rest)
        t = Table({})
        for part in dialect.split_list(body):
            _define(t, part)
        if m := re.search(rf"PARTITION\s+BY\s+RANGE\s*\(\s*{_NAME}\s*\)", tail, re.I):
            t.partition = {"column": m[1], "bounds": sorted(int(x) for x in re.findall(r"LESS\s+THAN\s*\(?\s*(-?\d+)", tail, re.I))}  # MAXVALUE: what is above the last
        own[name.lower()] = t
        if own is not self.local:
            self._changed()

    def _drop_table(self, ok: str | None, name: str) -> Result:
        if self.local.pop(name.lower(), None) is not None:
            self.spark.catalog.dropTempView(name.lower())
            return Result(message="ok")
        if others := [c for c, _ in self._children(name) if c != name.lower()]:
            raise EngineError(f"{', '.join(others)} refers to {name}")
        if self.state["tables"].pop(name.lower(), None) is None and not ok:
            raise EngineError(f"no table {name}")
        self.state["triggers"] = {k: t for k, t in self.state["triggers"].items() if t["table"] != name.lower()}
        self.spark.catalog.dropTempView(name.lower())
        self._changed()

    def _alter(self, name: str, what: str) -> Result:
        t, df = self._table(name), self.table(name)
        if m := re.match(rf"ADD\s+(?:COLUMN\s+)?{_NAME}\s+(.*)", what, re.I | re.S):
            _define(t, f"{m[1]} {m[2]}")
            df = df.withColumn(m[1], F.expr(t.defaults.get(m[1], "NULL")))
        elif m := re.match(rf"DROP\s+(?:COLUMN\s+)?{_NAME}$", what.strip(), re.I):
            df = df.drop(m[1])
            t.columns.pop(m[1])
            t.keys = [k for k in t.keys if m[1] not in k]
        elif m := re.match(rf"RENAME\s+(?:COLUMN\s+)?{_NAME}\s+TO\s+{_NAME}", what, re.I):
            df = df.withColumnRenamed(m[1], m[2])
            t.columns = {(m[2] if c == m[1] else c): k for c, k in t.columns.items()}
            t.keys = [[m[2] if c == m[1] else c for c in k] for k in t.keys]
        elif m := re.match(rf"(?:MODIFY|ALTER)\s+(?:COLUMN\s+)?{_NAME}\s+(\w+)(.*)", what, re.I):
            t.columns[m[1]] = _type(m[2] + m[3])
        else:
            return Result(message="nothing to do")
        self._write(t, df, False)
        self._changed()

    def _create_index(self, unique: str | None, index: str, name: str, cols: str) -> Result:
        t, own = self._table(name), [c.split()[0].strip("`") for c in dialect.split_list(cols)]
        if unique:
            t.keys.append(own)
            self._check_rows(t, self.table(name), None)
        self.state["indexes"][index.lower()] = {"table": name.lower(), "columns": own}
        self._changed()

    def _create_view(self, name: str, query: str) -> Result:
        self._register(query)
        self.spark.sql(query)
        self.state["views"][name.lower()] = query
        self._changed()

    def _drop(self, kind: str, ok: str | None, name: str) -> Result:
        kind = {"proc": "procedures", "procedure": "procedures", "sequence": "sequences", "view": "views", "trigger": "triggers", "index": "indexes"}[kind.lower()]
        if self.state[kind].pop(name.lower(), None) is None and not ok:
            raise EngineError(f"no such {kind[:-1]}: {name}")
        self._changed()

    def _create_sequence(self, name: str, rest: str) -> Result:
        number = lambda word: int(m[1]) if (m := re.search(rf"{word}\D*?(-?\d+)", rest, re.I)) else 1
        self.state["sequences"][name.lower()] = {"value": number("START"), "step": number("INCREMENT")}
        self._changed()

    # data
    def _insert(self, verb: str, name: str, cols: str | None, rest: str) -> Result:
        t = self._table(name)
        given = [c.strip("` \"") for c in dialect.split_list(cols)] if cols else list(t.columns)
        rest, update = dialect.cut(rest, "on", "duplicate", "key", "update")
        rest, conflict = dialect.cut(rest, "on", "conflict")
        on, where = list(t.keys), None
        if conflict is not None:
            target, action = dialect.cut(conflict, "do")
            if target.strip():
                on = [[c.strip("` ") for c in dialect.split_list(_parenthesised(target)[0])]]
                if sorted(map(str.lower, on[0])) not in [sorted(map(str.lower, k)) for k in t.keys]:
                    raise EngineError("ON CONFLICT names no key")
            if re.match(r"\s*UPDATE\s+SET\b", action or "", re.I):
                update, where = dialect.cut(re.sub(r"^\s*UPDATE\s+SET\b", "", action, flags=re.I), "where")
            elif not re.fullmatch(r"\s*NOTHING\s*", action or "", re.I):
                raise EngineError("ON CONFLICT is followed by DO NOTHING or DO UPDATE SET")
        select = self._numbered(rest)
        if re.match(r"\s*(?:VALUES|SELECT|WITH)\b", select, re.I) is None:
            raise EngineError("INSERT needs VALUES or a query")
        self._register(select)
        rows = self.spark.sql(f"SELECT * FROM ({self._values(t, given, select)})" if re.match(r"\s*VALUES", select, re.I) else select)
        if len(rows.columns) != len(given):
            raise EngineError("columns and values differ in number")
        rows = rows.toDF(*given)
        for c in t.columns:
            if c not in given and c != t.auto:
                rows = rows.withColumn(c, F.expr(t.defaults.get(c, "NULL")))
        if t.auto and t.auto not in rows.columns:
            rows = rows.withColumn(t.auto, F.lit(None).cast("bigint"))
        rows = rows.select(*(self._stored(f"`{c}`", k).alias(c) for c, k in t.columns.items()))
        rows = self._kept(t, rows.withColumn("_at", F.monotonically_increasing_id()))  # places in the statement, as written
        n = rows.count()
        if t.auto and n:
            rows = self._kept(t, _given_ids(rows, t.auto, t.next_id))
            self.last_id = rows.agg(F.max(t.auto)).first()[0]
            t.next_id = max(t.next_id, self.last_id + 1)
        replace, ignore = verb.lower().startswith("replace"), "ignore" in verb.lower() or conflict is not None
        if t.keys and (update or ignore or replace):
            return self._merge(t, name, rows, on, update, where, replace)
        rows = rows.drop("_at")
        self._check_rows(t, rows, self.table(name))
        self._fire("before insert", name)
        self._write(t, rows, True)
        self._fire("insert", name)
        self._touched(name)
        return Result(rows_affected=n, last_insert_id=self.last_id or None)

    def _touched(self, *names: str) -> None:
        if any(n.lower() not in self.local for n in names):
            self._changed()

    def _kept(self, t: Table, rows: DataFrame) -> DataFrame:
        """rows as a written table, so that what they hold does not change from one reading to the next."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _values(self, t: Table, given: list[str], select: str) -> str:
        """VALUES with DEFAULT spelled out."""
        ts = dialect.tokens(select)
        at, depth = 0, 0
        for x in ts:
            at = 0 if x.text == "(" and depth == 0 else at + (x.text == "," and depth == 1)
            depth += (x.text == "(") - (x.text == ")")
            if x.is_word("default") and depth == 1 and at < len(given):
                x.text = t.defaults.get(given[at], "NULL")
        return dialect.join(ts)

    def _stored(self, column: str, kind: str):
        """A value as its column's kind: the compat profile reads dates leniently and takes zeros for what cannot be read."""
        if not self.compat or kind not in scalars.ZERO:
            return F.col(column).cast(kind)
        return scalars.lenient_cast(F.col(column), kind)

    def _merge(self, t: Table, name: str, rows: DataFrame, keys: list[list[str]], update: str | None, where: str | None, replace: bool) -> Result:
        """Rows one after the other in effect: each that meets a key, of the table or of an earlier row, updates, replaces or is ignored.

        A row of the table that several rows meet is updated by them in turn; so is one that this statement has put in.
        """
        n, cols = rows.count(), list(t.columns)
        old = self._kept(t, self.table(name).withColumn("_old", F.monotonically_increasing_id()))
        keyed = lambda df, key: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
        met = None
        for order, key in enumerate(keys):
            hit = keyed(rows, key).select("_at", *key).join(keyed(old, key).select("_old", *key), key).select("_at", "_old", F.lit(order).alias("_order"))
            met = hit if met is None else met.union(hit)
        met = self._kept(t, met.groupBy("_at").agg(F.min_by("_old", F.struct("_order", "_old")).alias("_old"), F.countDistinct("_old").alias("_many")))
        rows = self._kept(t, rows.join(met, "_at", "left"))
        fresh = rows.where("_old IS NULL")
        for key in keys:  # of rows that are new and alike, a first one goes in, others meet it
            alike = Window.partitionBy(*key, F.when(F.concat(*(F.col(c).isNull().cast("string") for c in key)).contains("true"), F.col("_at"))).orderBy("_at")
            fresh = fresh.withColumn("_first", F.min("_at").over(alike)).withColumn("_lead", F.least("_first", F.coalesce("_lead", "_first")) if "_lead" in fresh.columns else F.col("_first")).drop("_first")
        fresh = self._kept(t, fresh)
        again = fresh.where("_lead <> _at")
        put = fresh.where("_lead = _at").drop("_lead")
        if replace:
            gone = met.select("_old").distinct()
            extra = None
            for key in keys:
                hit = keyed(rows, key).select(*key).join(keyed(old, key).select("_old", *key), key).select("_old")
                extra = hit if extra is None else extra.union(hit)
            gone = gone.union(extra).distinct()
            last = rows
            for key in keys:
                later = Window.partitionBy(*key, F.when(F.concat(*(F.col(c).isNull().cast("string") for c in key)).contains("true"), F.col("_at")))
                last = last.withColumn("_last", F.max("_at").over(later)).where("_last = _at").drop("_last")
            whole = old.join(gone, "_old", "left_anti").select(*cols).unionByName(last.select(*cols))
        elif update is None:
            whole = old.select(*cols).unionByName(put.select(*cols))
        else:
            base = old.select("_old", F.lit(None).cast("bigint").alias("_put"), *cols).unionByName(put.select(F.lit(None).cast("bigint").alias("_old"), F.col("_at").alias("_put"), *cols))
            turns = rows.where("_old IS NOT NULL").select("_old", F.lit(None).cast("bigint").alias("_put"), "_at", *cols).unionByName(again.select(F.lit(None).cast("bigint").alias("_old"), F.col("_lead").alias("_put"), "_at", *cols))
            whole = self._in_turn(t, name, base, turns, update, where).select(*cols)
        whole = self._kept(t, whole)
        self._check_rows(t, whole, None)
        for event in ("before insert", "before update"):
            self._fire(event, name)
        self._write(t, whole, False)
        if replace or not put.isEmpty():
            self._fire("insert", name)
        if update is not None and (not met.isEmpty() or not again.isEmpty()):
            self._fire("update", name)
        self._touched(name)
        return Result(rows_affected=n, last_insert_id=self.last_id or None)

    def _in_turn(self, t: Table, name: str, base: DataFrame, turns: DataFrame, update: str, where: str | None) -> DataFrame:
        """base after the updates of turns, the earliest row of each target first; a round takes one row of every target."""
        sets = dict(re.split(r"\s*=\s*", a.strip(), maxsplit=1) for a in dialect.split_list(update))
        sets = {c.rpartition(".")[2].strip("` "): e for c, e in sets.items()}
        number = F.row_number().over(Window.partitionBy("_old", "_put").orderBy("_at"))
        turns = self._kept(t, turns.withColumn("_turn", number))
        new = lambda e: re.sub(rf"\bEXCLUDED\s*\.\s*{_NAME}|\bVALUES\s*\(\s*{_NAME}\s*\)", lambda m: f"`_new_{(m[1] or m[2]).lower()}`", re.sub(rf"\b{re.escape(name)}\s*\.\s*", "", e, flags=re.I), flags=re.I)
        for turn in range(1, (turns.agg(F.max("_turn")).first()[0] or 0) + 1):
            now = turns.where(F.col("_turn") == turn).select(F.coalesce("_old", F.lit(-1)).alias("_o"), F.coalesce("_put", F.lit(-1)).alias("_p"), F.lit(True).alias("_met"), *(F.col(c).alias(f"_new_{c.lower()}") for c in t.columns))
            met = base.join(now, (F.coalesce("_old", F.lit(-1)) == F.col("_o")) & (F.coalesce("_put", F.lit(-1)) == F.col("_p")), "left")
            if where:
                met = met.withColumn("_met", F.col("_met") & F.coalesce(F.expr(new(where)), F.lit(False)))
            after = {c: F.when(F.col("_met"), F.expr(new(sets[own])).cast(k)).otherwise(F.col(c)) for c, k in t.columns.items() if (own := next((x for x in sets if x.lower() == c.lower()), None))}
            base = self._kept(t, met.select("_old", "_put", *(after.get(c, F.col(c)).alias(c) for c in t.columns)))
        return base

    def _insert_set(self, name: str, sets: str) -> Result:
        pairs = [re.split(r"\s*=\s*", a, maxsplit=1) for a in dialect.split_list(sets)]
        return self._insert("INSERT", name, ", ".join(c for c, _ in pairs), f"VALUES ({', '.join(v for _, v in pairs)})")

    def _check_rows(self, t: Table, rows: DataFrame, old: DataFrame | None) -> None:
        """Constraints of rows that are to stand beside old ones, each by one set-wise query."""
        for c in t.not_null:
            if c != t.auto and not rows.where(F.col(c).isNull()).isEmpty():
                raise EngineError(f"{c} must not be null")
        for check in t.checks:
            if not rows.where(f"NOT ({check})").isEmpty():
                raise EngineError(f"check ({check}) fails")
        for key in t.keys:
            known = rows.select(*key).na.drop()
            if not known.groupBy(*key).count().where("count > 1").isEmpty() or old is not None and not known.join(old.select(*key), key, "left_semi").isEmpty():
                raise EngineError(f"duplicate key ({', '.join(key)})")
        for f in t.foreign:
            parent = self.table(f["table"]).select(F.col(f["key"]).alias(f["column"]))
            if not rows.select(f["column"]).na.drop().join(parent, f["column"], "left_anti").isEmpty():
                raise EngineError(f"{f['column']} has no {f['table']}")

    def _update(self, head: str) -> Result:
        """UPDATE t SET ..., UPDATE a SET ... FROM t a JOIN ..., UPDATE t a JOIN ... SET ...; each with WHERE."""
        source, sets = dialect.cut(head, "set")
        if sets is None:
            raise EngineError("UPDATE needs SET")
        sets, where = dialect.cut(sets, "where")
        sets, other = dialect.cut(sets, "from")
        target, name, alias = self._target(source, other)
        t, old = self._table(name), self.table(name)
        given = {}
        for a in dialect.split_list(sets):
            c, e = re.split(r"\s*=\s*", a, maxsplit=1)
            own = next((x for x in t.columns if x.lower() == c.rpartition(".")[2].strip("` ").lower()), None)
            if own is None:
                raise EngineError(f"no column {c}")
            given[own] = t.defaults.get(own, "NULL") if e.strip().lower() == "default" else e
        hit = self._matching(name, alias, target, where, given)
        new = hit.select(*((F.when(F.col("_hit"), F.col(f"_new_{c}").cast(k)).otherwise(F.col(c)) if c in given else F.col(c)).alias(c) for c, k in t.columns.items()), "_hit")
        new = self._kept(t, new)
        n = new.where("_hit").count()
        if n:
            self._check_rows(t, new.drop("_hit"), None)
            for child, f in self._children(name):
                gone = old.select(f["key"]).na.drop().join(new.select(f["key"]), f["key"], "left_anti")
                if not self.table(child).join(gone.withColumnRenamed(f["key"], f["column"]), f["column"], "left_semi").isEmpty():
                    raise EngineError(f"{child} refers to {name}")
            self._fire("before update", name)
            self._rewrite(t, new, old, t.partition is None or t.partition["column"] in given)
            self._fire("update", name)
            self._touched(name)
        return Result(rows_affected=n)

    def _rewrite(self, t: Table, new: DataFrame, old: DataFrame, everywhere: bool) -> None:
        """Write new rows (with _hit) in place of a table's; of a partitioned one, only the partitions with a row that was hit."""
        if everywhere or not t.partition:
            return self._write(t, new.drop("_hit"), False)
        part = _part_of(t.partition)
        touched = {r[0] for r in new.where("_hit").select(part.alias("k")).distinct().collect()}  # as many as the table has partitions, at most
        kept = [p for p in t.paths if _part_number(p) not in touched]
        self._write(t, new.where(part.isin(list(touched))).drop("_hit"), False)
        t.paths = [*kept, *t.paths]

    def _target(self, source: str, other: str | None) -> tuple[str, str, str]:
        """(FROM list, table, alias) of an UPDATE or DELETE over one table or several."""
        first = re.match(rf"\s*{_NAME}(?:\s+(?:AS\s+)?(?!JOIN\b|INNER\b|LEFT\b|RIGHT\b|CROSS\b|FULL\b){_NAME})?", source, re.I)
        name, alias = first[1], first[2] or first[1]
        if other is None:
            return source, name, alias
        for m in re.finditer(rf"(?:^|,|\bJOIN\b)\s*{_NAME}(?:\s+(?:AS\s+)?(?!ON\b|JOIN\b|INNER\b|LEFT\b|RIGHT\b|CROSS\b|FULL\b|WHERE\b){_NAME})?", other, re.I):
            if name.lower() in ((m[2] or "").lower(), m[1].lower()):
                return other, m[1], m[2] or m[1]
        return f"{source}, {other}", name, alias

    def _matching(self, name: str, alias: str, source: str, where: str | None, given: dict[str, str]) -> DataFrame:
        """The table with _hit, whether a row meets the condition, and _new_c for each given column; any subquery, any join will do.

        A row that a join meets several times takes the values of one of them.
        """
        one = re.fullmatch(rf"\s*{_NAME}(?:\s+(?:AS\s+)?{_NAME})?\s*", source, re.I)
        texts = [where or "true", *given.values()]
        if one and not any(dialect.cut(x.replace("(", " ").replace(")", " "), "select")[1] is not None for x in texts):
            df = self.table(name).alias(alias)
            hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
            return df.select(*(F.col(f"{alias}.`{c}`") for c in self._table(name).columns), hit.alias("_hit"), *(F.expr(e).alias(f"_new_{c}") for c, e in given.items()))
        df = self._kept(self._table(name), self.table(name).withColumn("_row", F.monotonically_increasing_id()))
        self._register(" ".join([source, *texts]))
        df.createOrReplaceTempView(name.lower())
        found = self.spark.sql(f"SELECT {alias}._row AS _row{''.join(f', {e} AS `_new_{c}`' for c, e in given.items())} FROM {source}" + (f" WHERE {where}" if where else ""))
        found = found.groupBy("_row").agg(F.lit(True).alias("_found"), *(F.first(f"_new_{c}").alias(f"_new_{c}") for c in given))
        self.table(name).createOrReplaceTempView(name.lower())
        return df.join(found, "_row", "left").withColumn("_hit", F.coalesce("_found", F.lit(False))).drop("_row", "_found")

    def _delete(self, head: str) -> Result:
        """DELETE FROM t, DELETE a FROM t a JOIN ..., DELETE FROM t USING ...; each with WHERE."""
        rest, where = dialect.cut(head, "where")
        first, other = dialect.cut(rest, "from")
        if other is None:
            raise EngineError("DELETE needs FROM")
        if not first.strip():
            other, using = dialect.cut(other, "using")
            source, name, alias = self._target(other, None)
            source = source if using is None else f"{source}, {using}"
        else:
            source, name, alias = self._target(first, other)
        t = self._table(name)
        marked = self._kept(t, self._matching(name, alias, source, where, {}))
        n = self._remove(name, marked)
        if n:
            self._touched(name)
        return Result(rows_affected=n)

    def _children(self, name: str):
        return [(c, f) for c, t in self.state["tables"].items() for f in t.foreign if f["table"] == name.lower()]

    def _remove(self, name: str, marked: DataFrame) -> int:
        """Write the rows without _hit; children of the others follow their own rule, to any depth. Triggers fire on every table."""
        t = self._table(name)
        gone = marked.where("_hit").drop("_hit")
        n = gone.count()
        if not n:
            return 0
        self._fire("before delete", name)
        self._rewrite_without(t, marked)
        for child, f in self._children(name):
            ct, rows = self._table(child), self.table(child)
            keys = gone.select(F.col(f["key"]).alias("_key")).distinct().na.drop()
            met = self._kept(ct, rows.join(keys, rows[f["column"]] == keys["_key"], "left").withColumn("_hit", F.col("_key").isNotNull()).drop("_key"))
            if met.where("_hit").isEmpty():
                continue
            if f["rule"] == "cascade":
                self._remove(child, met)
            elif f["rule"] == "set null":
                self._write(ct, met.withColumn(f["column"], F.when(~F.col("_hit"), F.col(f["column"]))).drop("_hit"), False)
                self._fire("update", child)
            else:
                raise EngineError(f"{child} refers to {name}")
        self._fire("delete", name)
        return n

    def _rewrite_without(self, t: Table, marked: DataFrame) -> None:
        if not t.partition:
            return self._write(t, marked.where("NOT _hit").drop("_hit"), False)
        part = _part_of(t.partition)
        touched = {r[0] for r in marked.where("_hit").select(part.alias("k")).distinct().collect()}
        kept = [p for p in t.paths if _part_number(p) not in touched]
        self._write(t, marked.where(part.isin(list(touched))).where("NOT _hit").drop("_hit"), False)
        t.paths = [*kept, *t.paths]

    def _truncate(self, name: str) -> Result:
        t = self._table(name)
        if any(not self.table(c).where(F.col(f["column"]).isNotNull()).isEmpty() for c, f in self._children(name)):
            raise EngineError(f"other tables refer to {name}")
        t.paths, t.next_id = [], 1
        self._touched(name)

    # transactions
    def _begin(self) -> Result:
        if self.open is not None:
            self._end(True)
        self.open, self.savepoints = copy.deepcopy(self.state), []

    def _end(self, keep: bool) -> Result:
        if self.open is not None:
            before, self.open, self.savepoints = self.open, None, []
            if keep:
                self._commit()
            else:
                self.state = before

    def _savepoint(self, name: str) -> Result:
        if self.open is None:
            raise EngineError("no transaction")
        self.savepoints.append((name.lower(), copy.deepcopy(self.state)))

    def _back(self, name: str, drop: bool) -> Result:
        at = next((k for k in range(len(self.savepoints) - 1, -1, -1) if self.savepoints[k][0] == name.lower()), None)
        if at is None:
            raise EngineError(f"no savepoint {name}")
        if drop:
            del self.savepoints[at:]
        else:
            self.state = copy.deepcopy(self.savepoints[at][1])
            del self.savepoints[at + 1 :]

    # procedures, triggers, cursors
    def _fire(self, event: str, name: str) -> None:
        if self.depth > 16:
            raise EngineError("triggers nest too deep")
        for tr in list(self.state["triggers"].values()):
            if tr["event"] == event and tr["table"] == name.lower():
                self.depth += 1
                keep, self.open = self.open, self.open or {}  # what a trigger does is committed with what fired it
                try:
                    for s in dialect.statements(tr["body"]):
                        self.execute(s)
                finally:
                    self.depth -= 1
                    self.open = keep

    def _trigger(self, name: str, *said: str) -> Result:
        """Both spellings: AFTER INSERT ON t ..., and ON t AFTER INSERT AS ...; BEFORE fires ahead of the change."""
        when, event, table, body = said if said[0].lower() in ("after", "before") else (said[1], said[2], said[0], said[3])
        self._table(table)
        event = event.lower() if when.lower() == "after" else f"before {event.lower()}"
        self.state["triggers"][name.lower()] = {"event": event, "table": table.lower(), "body": _body(body)}
        self._changed()

    def _procedure(self, name: str, rest: str) -> Result:
        """Parameters (@a INT, in parentheses or not, with = default) stand for literals in the body."""
        params, body = dialect.cut(rest, "as")
        if body is None or re.match(r"\s*BEGIN\b", rest, re.I):
            params, body = "", rest
        params = params.strip()
        params = _parenthesised(params)[0] if params.startswith("(") else params
        known = []
        for p in dialect.split_list(params):
            m = re.match(r"(?:IN\s+)?(@?\w+)\s+\w+(?:\s*\([^)]*\))?\s*(?:=\s*(.*))?$", p, re.I | re.S)
            if m is None:
                raise EngineError(f"not a parameter: {p}")
            known.append([m[1].lower(), m[2]])
        self.state["procedures"][name.lower()] = {"params": known, "body": _body(body)}
        self._changed()

    def _call(self, name: str, given: str | None) -> Result:
        p = self.state["procedures"].get(name.lower())
        if p is None:
            raise EngineError(f"no procedure {name}")
        given = (given or "").strip()
        given = _parenthesised(given)[0] if given.startswith("(") else given
        values = {k: v for k, v in p["params"]}
        for k, x in enumerate(dialect.split_list(given)):
            if m := re.match(r"(@\w+)\s*=\s*(.*)", x, re.S):
                values[m[1].lower()] = m[2]
            elif k < len(p["params"]):
                values[p["params"][k][0]] = x
            else:
                raise EngineError("too many arguments")
        if missing := [k for k, v in values.items() if v is None]:
            raise EngineError(f"no value for {', '.join(missing)}")
        result = Result(message="ok")
        for s in dialect.statements(p["body"]):
            ts = dialect.tokens(s)
            for x in ts:
                if x.kind == "word" and x.text.lower() in values:
                    x.text = values[x.text.lower()]
            result = self.execute(dialect.join(ts))
        return result

    def _prepare(self, name: str, text: str) -> Result:
        self.prepared[name.lower()] = text[1:-1].replace("''", "'")

    def _execute(self, name: str, using: str | None) -> Result:
        values = iter(dialect.split_list(using or ""))
        parts = [dialect.Token("x", next(values)) if t.text == "?" and t.kind == "sign" else t for t in dialect.tokens(self.prepared[name.lower()])]
        return self.execute(dialect.join(parts))

    def _cursor(self, name: str, query: str) -> Result:
        self.cursors[name.lower()] = {"query": query, "rows": None}

    def _cursor_do(self, what: str, name: str) -> Result:
        c, what = self.cursors[name.lower()], what.lower()
        if what == "open":
            c["frame"] = self._query(c["query"]).frame
            c["rows"] = c["frame"].toLocalIterator()
        elif what == "close":
            c["rows"] = None
        else:
            del self.cursors[name.lower()]

    def _fetch(self, name: str) -> Result:
        c = self.cursors[name.lower()]
        if c["rows"] is None:
            raise EngineError("the cursor is not open")
        row = next(c["rows"], None)
        return Result(message="DONE") if row is None else Result(self.spark.createDataFrame([row], c["frame"].schema))

    # catalog
    def _show(self) -> Result:
        return Result(self.spark.createDataFrame([(n,) for n in sorted(self.state["tables"])], "table_name string"))

    def _schema_tables(self) -> DataFrame:
        rows = [("def", "main", n, "BASE TABLE") for n in sorted(self.state["tables"])] + [("def", "main", n, "VIEW") for n in sorted(self.state["views"])]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")

    def _schema_columns(self) -> DataFrame:
        rows = [("def", "main", n, c, k, at, "NO" if c in t.not_null else "YES", t.defaults.get(c)) for n, t in sorted(self.state["tables"].items()) for at, (c, k) in enumerate(t.columns.items(), 1)]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, data_type string, ordinal_position int, is_nullable string, column_default string")

    def _describe(self, name: str) -> Result:
        t = self._table(name)
        rows = [(c, k, "NO" if c in t.not_null else "YES", "PRI" if t.keys and c in t.keys[0] else "", t.defaults.get(c)) for c, k in t.columns.items()]
        return Result(self.spark.createDataFrame(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string"))

    def _show_create(self, name: str) -> Result:
        t = self._table(name)
        cols = ", ".join(f"`{c}` {k}{' NOT NULL' if c in t.not_null else ''}" for c, k in t.columns.items())
        return Result(self.spark.createDataFrame([(name, f"CREATE TABLE `{name}` ({cols})")], "`Table` string, `Create Table` string"))

    def _explain(self, query: str) -> Result:
        frame = self._query(query).frame
        text = frame._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(self.spark.createDataFrame([(x,) for x in text.split("\n") if x], "`Query Plan` string"))

    def _analyze(self, name: str) -> Result:
        """Exact statistics of all columns; the distinct values of a column are counted after they have been thinned task by task."""
        df = self.table(name)
        cols = df.columns
        ends = df.agg(F.count("*").alias("n"), *(f(c).cast("string").alias(f"{w}_{k}") for k, c in enumerate(cols) for w, f in (("lo", F.min), ("hi", F.max), ("some", F.count)))).first()
        each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in enumerate(cols)])).alias("x")).select("x.*")
        counts = {r["k"]: r["n"] for r in each.where("v IS NOT NULL").distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}
        rows = [(c, ends["n"], counts.get(k, 0), ends["n"] - int(ends[f"some_{k}"]), ends[f"lo_{k}"], ends[f"hi_{k}"]) for k, c in enumerate(cols)]
        return Result(self.spark.createDataFrame(rows, "column_name string, row_count long, distinct_count long, null_count long, min_value string, max_value string"))

    def _grant(self, text: str) -> Result:
        self.state["grants"].append(text)
        self._changed()

    def _backup(self, to: str) -> Result:
        """Copy all current tables and the catalog to another folder, with Spark's readers and writers."""
        other = Engine(self.spark, to)
        for name, t in self.state["tables"].items():
            held = copy.deepcopy(t)
            other._write(held, self.table(name), False)
            other.state["tables"][name] = held
        for k in ("views", "sequences", "procedures", "triggers", "indexes", "grants"):
            other.state[k] = copy.deepcopy(self.state[k])
        other._commit()

    def _restore(self, path: str) -> Result:
        self.state = copy.deepcopy(Engine(self.spark, path).state)
        self._changed()


_PART = "_part"


def _part_of(partition: dict):
    """The number of a row's partition: that of the first bound above its key; rows without a key are in the first."""
    part = F.lit(len(partition["bounds"]))
    for k, b in reversed(list(enumerate(partition["bounds"]))):
        part = F.when(F.col(partition["column"]) < b, k).otherwise(part)
    return F.when(F.col(partition["column"]).isNull(), 0).otherwise(part)


def _part_number(path: str) -> int:
    return int(path.rpartition("=")[2])


def _part_meets(bounds: list[int], path: str, asked: tuple[float | None, float | None]) -> bool:
    """Whether a partition's folder can hold keys from the first to the second of asked."""
    k, (low, high) = _part_number(path), asked
    return (high is None or k == 0 or high >= bounds[k - 1]) and (low is None or k == len(bounds) or low < bounds[k])


def _asked(sql: str, column: str) -> tuple[float | None, float | None] | None:
    """The range of a column that a query asks for, where its text is one SELECT whose conditions are joined by AND."""
    ts = dialect.tokens(sql)
    if sum(t.is_word("select") for t in ts) != 1 or any(t.is_word("or", "not", "union", "outer", "left", "right", "full") for t in ts):
        return None
    low = high = None
    value = lambda k: float(ts[k].text) if k < len(ts) and ts[k].kind == "number" and (k + 1 == len(ts) or ts[k + 1].is_word("and", "group", "order", "limit") or ts[k + 1].text in (")", ";")) else None
    where = next((k for k, t in enumerate(ts) if t.is_word("where")), len(ts))
    for k in range(where, len(ts)):
        if ts[k].text.strip("`").lower() != column.lower() or ts[k].kind not in ("word", "name") or not (ts[k - 1].is_word("where", "and") or ts[k - 1].text == "."):
            continue
        op = ts[k + 1].text.lower() if k + 1 < len(ts) else ""
        if op == "between" and k + 4 < len(ts) and ts[k + 3].is_word("and") and ts[k + 2].kind == "number" and (x := value(k + 4)) is not None:
            low, high = max(float(ts[k + 2].text), low if low is not None else -1e300), min(x, high if high is not None else 1e300)
        elif op in ("=", ">", ">=", "<", "<=") and (x := value(k + 2)) is not None:
            if op in ("=", ">", ">="):
                low = x if low is None else max(low, x)
            if op in ("=", "<", "<="):
                high = x if high is None else min(high, x)
    return None if low is None and high is None else (low, high)


def _given_ids(rows: DataFrame, auto: str, first: int) -> DataFrame:
    """rows with numbers for their missing ids, in the order of _at: the task that made a row is told by _at, each task's
    rows are counted, and the sums before it tell where it begins."""
    spark = rows.sparkSession
    rows = rows.withColumn("_task", F.shiftright("_at", 33).cast("int")).withColumn(auto, F.col(auto).cast("bigint"))
    missing = {r[0]: r[1] for r in rows.where(F.col(auto).isNull()).groupBy("_task").count().collect()}  # a row a task
    if not missing:
        return rows.drop("_task")
    starts, at = [], first
    for task, n in sorted(missing.items()):
        starts.append((task, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(starts, "_task int, _start long"))
    # Numbered by their places in the statement, task by task: no task has more rows than it read.
    number = F.row_number().over(Window.partitionBy("_task", F.col(auto).isNull()).orderBy("_at"))
    rows = rows.join(starts, "_task", "left").withColumn("_n", number)
    return rows.withColumn(auto, F.coalesce(F.col(auto), F.col("_start") + F.col("_n") - 1)).drop("_task", "_start", "_n")


_SCHEMA_VIEWS = {"information_schema_tables": Engine._schema_tables, "information_schema_columns": Engine._schema_columns}


def _body(text: str) -> str:
    text = text.strip()
    m = re.match(r"BEGIN\b(.*)\bEND$", text, re.I | re.S)
    return (m[1] if m else text).strip()


def _parenthesised(text: str) -> tuple[str, str]:
    """What the first parenthesis holds, and what follows it."""
    ts = dialect.tokens(text)
    k = next((k for k, t in enumerate(ts) if t.text == "("), None)
    if k is None or ts[j := dialect.close(ts, k)].text != ")":
        raise EngineError("parentheses do not match")
    return dialect.join(ts[k + 1 : j]), dialect.join(ts[j + 1 :])


def _type(text: str) -> str:
    m = re.match(r"\s*(\w+)\s*(\([^)]*\))?", text)
    kind = TYPES.get(m[1].lower())
    if kind is None:
        raise EngineError(f"unknown type {m[1]}")
    return kind + ((m[2] or "(18,0)") if kind == "decimal" else "")


def _define(t: Table, part: str) -> None:
    """One column or table constraint of CREATE TABLE."""
    part = re.sub(rf"^CONSTRAINT\s+{_NAME}\s+", "", part.strip(), flags=re.I)
    names = lambda x: [c.strip("` \"").split()[0] for c in dialect.split_list(x)]
    refers = rf"REFERENCES\s+{_NAME}\s*\(\s*{_NAME}\s*\)(?:\s+ON\s+DELETE\s+(CASCADE|SET\s+NULL|RESTRICT|NO\s+ACTION))?"
    rule = lambda x: re.sub(r"\s+", " ", (x or "restrict").lower())
    if m := re.match(r"(?:PRIMARY\s+KEY|UNIQUE(?:\s+(?:KEY|INDEX))?)\s*\w*\s*\(([^)]*)\)", part, re.I):
        t.keys.append(names(m[1]))
        t.not_null += names(m[1]) if part.lower().startswith("primary") else []
    elif m := re.match(rf"FOREIGN\s+KEY\s*\(\s*{_NAME}\s*\)\s*{refers}", part, re.I):
        t.foreign.append({"column": m[1], "table": m[2].lower(), "key": m[3], "rule": rule(m[4])})
    elif re.match(r"CHECK\s*\(", part, re.I):
        t.checks.append(_parenthesised(part)[0])
    elif re.match(r"(?:KEY|INDEX|FULLTEXT)\b", part, re.I):
        return
    else:
        m = re.match(rf"{_NAME}\s+(.*)", part, re.S)
        name, rest = m[1], m[2]
        t.columns[name] = _type(rest)
        if re.search(r"\bNOT\s+NULL\b", rest, re.I):
            t.not_null.append(name)
        if re.search(r"\bAUTO_INCREMENT\b", rest, re.I):
            t.auto = name
        if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I):
            t.keys.insert(0, [name])
            t.not_null.append(name)
        elif re.search(r"\bUNIQUE\b", rest, re.I):
            t.keys.append([name])
        if c := re.search(r"\bCHECK\s*\(", rest, re.I):
            t.checks.append(_parenthesised(rest[c.start() :])[0])
        if d := re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[-\w.]+(?:\([^)]*\))?)", rest, re.I):
            t.defaults[name] = d[1]
        if f := re.search(refers, rest, re.I):
            t.foreign.append({"column": name, "table": f[1].lower(), "key": f[2], "rule": rule(f[3])})


_E = Engine
#: Statements whose bodies are kept as they are written: they are rewritten when they run.
_VERBATIM = [
    (rf"CREATE\s+(?:OR\s+ALTER\s+)?PROC(?:EDURE)?\s+{_NAME}\s*(.*)", _E._procedure),
    (rf"CREATE\s+TRIGGER\s+{_NAME}\s+(AFTER|BEFORE)\s+(INSERT|UPDATE|DELETE)\s+ON\s+{_NAME}\s+(?:FOR\s+EACH\s+(?:ROW|STATEMENT)\s+)?(?:AS\s+)?(.*)", _E._trigger),
    (rf"CREATE\s+TRIGGER\s+{_NAME}\s+ON\s+{_NAME}\s+(AFTER|BEFORE)\s+(INSERT|UPDATE|DELETE)\s+(?:AS\s+)?(.*)", _E._trigger),
    (rf"(?:EXEC(?:UTE)?\s+(?:PROC(?:EDURE)?\s+)?(?!.*\bUSING\b)|CALL\s+){_NAME}\s*(.*)$", lambda e, n, given: e._call(n, given) if n.lower() in e.state["procedures"] or n.lower() not in e.prepared else e._execute(n, None)),
    (rf"PREPARE\s+{_NAME}\s+FROM\s+('.*')$", _E._prepare),
]
_STATEMENTS = [
    (rf"CREATE\s+(TEMPORARY\s+|TEMP\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(\(.*)", _E._create_table),
    (rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{_NAME}$", _E._drop_table),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+(.*)", _E._alter),
    (rf"CREATE\s+(?:(UNIQUE)\s+|FULLTEXT\s+|CLUSTERED\s+)?INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\(([^)]*)\).*", _E._create_index),
    (rf"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+{_NAME}\s+AS\s+(.*)", _E._create_view),
    (rf"DROP\s+(PROCEDURE|PROC|SEQUENCE|VIEW|TRIGGER|INDEX)\s+(IF\s+EXISTS\s+)?{_NAME}.*", _E._drop),
    (rf"CREATE\s+SEQUENCE\s+{_NAME}(.*)", _E._create_sequence),
    (rf"(INSERT(?:\s+IGNORE)?|REPLACE)\s+(?:INTO\s+)?{_NAME}\s*(?:\(((?:\s*[`\"]?\w+[`\"]?\s*,?)+)\)\s*)?((?:VALUES|SELECT|WITH)\b.*)", _E._insert),
    (rf"INSERT\s+(?:INTO\s+)?{_NAME}\s+SET\s+(.*)", _E._insert_set),
    (r"UPDATE\s+(.*)", _E._update),
    (r"DELETE\s+(.*)", _E._delete),
    (rf"TRUNCATE\s+(?:TABLE\s+)?{_NAME}$", _E._truncate),
    (r"(?:BEGIN(?:\s+TRAN(?:SACTION)?)?|START\s+TRANSACTION)$", _E._begin),
    (r"COMMIT(?:\s+TRAN(?:SACTION)?)?$", lambda e: e._end(True)),
    (rf"ROLLBACK\s+TO\s+(?:SAVEPOINT\s+)?{_NAME}$", lambda e, n: e._back(n, False)),
    (r"ROLLBACK(?:\s+TRAN(?:SACTION)?)?$", lambda e: e._end(False)),
    (rf"RELEASE\s+SAVEPOINT\s+{_NAME}$", lambda e, n: e._back(n, True)),
    (rf"SAVE(?:POINT|\s+TRAN(?:SACTION)?)\s+{_NAME}$", _E._savepoint),
    (rf"EXECUTE\s+{_NAME}(?:\s+USING\s+(.*))?$", _E._execute),
    (rf"DEALLOCATE\s+PREPARE\s+{_NAME}$", lambda e, n: e.prepared.pop(n.lower(), None) and None),
    (rf"DECLARE\s+{_NAME}\s+CURSOR\s+FOR\s+(.*)", _E._cursor),
    (rf"(OPEN|CLOSE|DEALLOCATE)\s+{_NAME}$", _E._cursor_do),
    (rf"FETCH\s+(?:NEXT\s+FROM\s+)?{_NAME}$", _E._fetch),
    (r"SHOW\s+TABLES$", _E._show),
    (rf"SHOW\s+CREATE\s+TABLE\s+{_NAME}$", _E._show_create),
    (rf"(?:DESCRIBE|DESC|SHOW\s+COLUMNS\s+FROM)\s+{_NAME}$", _E._describe),
    (r"EXPLAIN\s+(.*)", _E._explain),
    (rf"ANALYZE\s+TABLE\s+{_NAME}$", _E._analyze),
    (r"((?:GRANT|REVOKE|CREATE\s+USER|CREATE\s+LOGIN|DROP\s+USER)\b.*)", _E._grant),
    (r"BACKUP\s+(?:DATABASE\s+\w*\s*)?TO\s+(?:DISK\s*=\s*)?('[^']*')$", lambda e, to: e._backup(to[1:-1])),
    (r"RESTORE\s+(?:DATABASE\s+\w*\s*)?FROM\s+(?:DISK\s*=\s*)?('[^']*')$", lambda e, path: e._restore(path[1:-1])),
    (r"(?:SET|USE|CREATE\s+DATABASE|DROP\s+DATABASE|PRINT)\b.*", lambda e: None),
]
