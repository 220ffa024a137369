"""Flat tables from nested records by shared inlining (problem 3).

``schema_graph`` analyses a column of JSON text: every path with the kinds seen there is
counted in one distributed pass, so the whole data decide, not a sample.  ``inline_plan``
then applies shared inlining: singleton descendants become columns of the nearest table
above, while elements that repeat, are reached from several parents or contain themselves
get a table of their own with a foreign key.  ``post_plan`` does so for landed posts: the
post is shared (a payload is one, lists them or holds them in an envelope), elements that
TESTDATA.md declares as lists repeat even where the data have lone objects only, and an
element below itself goes to the table of the outer one.  ``shred`` fills the tables of a
plan in a second pass over the payloads, and ``p3_found`` reads its rows from them.

Both passes parse a payload once, in Arrow batches of Python: shapes differ from record to
record, and the same over VARIANT (a value opened, tested and cast at each level) took
1,937 CPU seconds a GB.

Shapes are made alike before they are cut up: a lone object or scalar where a list
belongs is a list of one, and a list or object that stands as JSON text counts as what it
holds.  Null elements keep their place in the numbering and give no row.  A payload that
is null, empty or broken gives no row in any table; of a member that stands twice the last
counts.  Repeated records stay repeated, told apart only by the key columns of the caller.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionlake.functions.binding import let
from mentionlake.session import scratch

#: Bound on the paths of the schema graph, which come to the driver.
MAX_PATHS = 10_000
#: Rows of a batch that ``shred`` gives.
BATCH_ROWS = 20_000


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def kind(v: Column) -> Column:
    """array, object, scalar (text included) or null, of a VARIANT value."""
    return F.when(_absent(v), F.lit("null")).when(_array(v).isNotNull(), F.lit("array")).when(_object(v).isNotNull(), F.lit("object")).otherwise(F.lit("scalar"))


def _held(v: Column) -> Column:
    """What a scalar holds that is JSON text of a list or object, else null."""
    said = F.try_variant_get(v, "$", "string")
    return F.when(said.rlike(r"^\s*[\[{]"), F.try_parse_json(said))


def opened(v: Column) -> Column:
    """``v``, or what it holds if it is JSON text of a list or object."""
    return let(v, lambda x: F.when(_array(x).isNotNull() | _object(x).isNotNull(), x).otherwise(F.coalesce(_held(x), x)))


def as_list(v: Column) -> Column:
    """array<variant> of ``v``: empty for null, of one element for a lone value."""
    none = F.expr("cast(array() as array<variant>)")

    def lone(x: Column) -> Column:
        return F.when(_object(x).isNotNull(), F.array(x)).otherwise(let(_held(x), lambda h: F.coalesce(_array(h), F.when(h.isNotNull(), F.array(h)), F.array(x))))

    return let(v, lambda x: F.when(_absent(x), none).otherwise(F.coalesce(_array(x), lone(x))))


def member(v: Column, name: str) -> Column:
    """The member ``name`` of an object, null for anything else."""
    return F.try_variant_get(opened(v), f"$.{name}", "variant")


def text(v: Column) -> Column:
    """The text of a scalar, null for objects, lists and null."""
    return F.when(kind(v) == "scalar", F.try_variant_get(v, "$", "string"))


@dataclass(frozen=True)
class Element:
    """A node of the schema graph: its path from the root, the kinds seen, and how often."""

    path: str
    kinds: dict[str, int] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.path.replace("[]", "").rpartition(".")[2]

    @property
    def repeated(self) -> bool:
        return "array" in self.kinds


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_float=str, parse_constant=_no_constant).decode


def _parsed(said: str | None):
    """What a payload holds, None if it is broken."""
    if not said:
        return None
    try:
        return _decode(said)
    except (ValueError, RecursionError):
        return None


def _open(v):
    """``v``, or what it holds if it is JSON text of a list or object."""
    if type(v) is str and v.lstrip(" \t\n\r\x0b\x0c")[:1] in ("[", "{"):
        held = _parsed(v)
        return v if held is None else held
    return v


def _said(v) -> str | None:
    """The text of a scalar, None for objects, lists and null."""
    if v is None or type(v) in (dict, list):
        return None
    if type(v) is bool:
        return "true" if v else "false"
    v = v if type(v) is str else str(v)
    return v if v.isascii() else v.encode("utf-8", "replace").decode()


def _kind_of(v) -> str:
    return "null" if v is None else "array" if type(v) is list else "object" if type(v) is dict else "scalar"


def _count(v, path: str, found: dict[tuple[str, str], int]) -> None:
    v = _open(v)
    key = (path, _kind_of(v))
    found[key] = found.get(key, 0) + 1
    if type(v) is dict:
        for k, w in v.items():
            _count(w, f"{path}.{k}", found)
    elif type(v) is list:
        below = path + "[]"
        for w in v:
            _count(w, below, found)


def schema_graph(df: DataFrame, payload: str, member_: str | None = None) -> list[Element]:
    """The elements below a column of JSON text, over all rows.

    ``member_``: the member in which an envelope lists its elements; a lone object without it
    counts as a list of one, so that paths below ``$.`` are an envelope's.

    Each batch counts its (path, kind) before anything moves; more than MAX_PATHS paths is an
    error (then members are data, not structure).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        for b in batches:
            for said in b.column(0).to_pylist():
                if (v := _parsed(said)) is not None:
                    try:
                        v = _open(v)
                        _count(v, "$[]" if member_ and type(v) is dict and member_ not in v else "$", found)
                    except RecursionError:
                        continue
            if len(found) > 4 * MAX_PATHS:
                raise ValueError(f"more than {MAX_PATHS} paths")
        rows = [(p.encode("utf-8", "replace").decode(), k, n) for (p, k), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "kind", "n"])

    counts = df.select(payload).where(F.col(payload).isNotNull()).mapInArrow(run, "path string, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n")).limit(4 * MAX_PATHS + 1).collect()
    found: dict[str, dict[str, int]] = {}
    for r in counts:
        found.setdefault(r.path, {})[r.kind] = r.n
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths")
    return [Element(p, k) for p, k in sorted(found.items())]


def inline_plan(graph: list[Element]) -> dict[str, list[str]]:
    """Table name -> the columns inlined into it, by shared inlining over the graph.

    A path gets a table if it repeats, if its element has more than one parent element
    that holds objects (shared), or if it lies below itself (recursive).
    """
    paths = {e.path.replace("[]", "") for e in graph if e.path != "$"}
    holds = {p.rpartition(".")[0] for p in paths}
    repeated = {e.path.replace("[]", "") for e in graph if e.repeated}
    parents: dict[str, set[str]] = {}
    for p in paths:
        head, _, name = p.rpartition(".")
        parents.setdefault(name, set()).add(head.rpartition(".")[2])
    own = {"$"}
    for p in paths:
        name = p.rpartition(".")[2]
        if p in repeated or (p in holds and (len(parents[name]) > 1 or name in p.rpartition(".")[0].split("."))):
            own.add(p)
    tables: dict[str, list[str]] = {t: [] for t in sorted(own)}
    for p in sorted(paths - own):
        if p in holds:
            continue
        head = p.rpartition(".")[0]
        while head not in own:
            head = head.rpartition(".")[0]
        tables[head].append(p[len(head) + 1 :])
    return tables


@dataclass(frozen=True)
class Table:
    """A table of a plan: its path of members below the root element, the tables above it from the
    outermost, its inlined columns (name -> members below an element), and whether it is recursive."""

    name: str
    path: tuple[str, ...]
    above: tuple[str, ...] = ()
    columns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    recursive: bool = False


@dataclass(frozen=True)
class Plan:
    """The tables of one root element (first the root's own), and what stands beside it in an envelope."""

    name: str
    member: str
    tables: tuple[Table, ...]
    beside: tuple[Table, ...] = ()
    names: tuple[tuple[str, str], ...] = ()
    labels: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = ()


#: Elements that are lists by declaration, by table name; other elements are found in the data.
DECLARED = {
    "comment": ("comment_texts",), "reply": ("comment_texts", "replies"), "signal": ("geo_enrichment", "top_signals"), "signal_match": ("geo_enrichment", "top_signals", "raw_matches"),
    "candidate": ("geo_enrichment", "top_candidates"), "candidate_source": ("geo_enrichment", "top_candidates", "sources"), "product": ("product_mentions",), "product_place": ("product_mentions", "found_in"),
}
#: Other names of members of a post.
OTHER_NAMES = {"comments_json": "comment_texts"}
#: child -> (table above or none, the members of an element that label it; () is the element itself)
LABELS = {
    "comment": (None, (("author", "username"), ("author",))), "reply": ("comment", (("author", "username"), ("author",))), "signal": (None, (("location",),)), "signal_match": ("signal", ((),)),
    "candidate": (None, (("location",),)), "candidate_source": ("candidate", ((),)), "product": (None, (("product",),)), "product_place": ("product", ((),)),
}


def _below_root(graph: list[Element], member_: str, other: dict[str, str], beside: bool) -> dict[str, dict[str, int]]:
    """Path -> kinds as seen from the root element (or, ``beside``, from the envelope without it)."""
    found: dict[str, dict[str, int]] = {}
    for e in graph:
        names = e.path.split(".")[1:]
        of_envelope = e.path.startswith("$.")
        listed = of_envelope and names[0].replace("[]", "") == member_
        if beside != (of_envelope and not listed):
            continue
        names = names[1:] if listed else names
        if not names:
            continue
        first = names[0].replace("[]", "")
        names[0] = other.get(first, first) + names[0][len(first) :]
        kinds = found.setdefault(".".join(["$", *names]), {})
        for k, n in e.kinds.items():
            kinds[k] = kinds.get(k, 0) + n
    return found


def _tables(kinds: dict[str, dict[str, int]], declared: dict[str, tuple[str, ...]], prefix: str) -> list[Table]:
    """The tables that shared inlining gives, besides the root's own, outer ones first; root first."""
    inlined = inline_plan([Element(p, k) for p, k in sorted(kinds.items())])
    own = {tuple(p.split(".")[1:]): list(c) for p, c in inlined.items() if p != "$"}
    for path in declared.values():
        own.setdefault(path, [])

    def outer(path: tuple[str, ...]) -> tuple[str, ...]:
        """The table of an element that lies below another of its name: that of the outer one."""
        out: tuple[str, ...] = ()
        for i, n in enumerate(path):
            again = n in out and path[: i + 1] in own and out[: out.index(n) + 1] in own
            out = out[: out.index(n) + 1] if again else (*out, n)
        return out

    scalars = {p.replace("[]", "") for p, k in kinds.items() if "scalar" in k}
    columns: dict[tuple[str, ...], dict[str, tuple[str, ...]]] = {(): {}}
    recursive = set()
    for path in sorted(own, key=len):
        at = outer(path)
        if at != path:
            recursive.add(at)
        columns.setdefault(at, {})
    every = sorted(p.split(".")[1:] for p in {p.replace("[]", "") for p in kinds} if p != "$")
    holds = {tuple(p[:-1]) for p in every}
    for p in map(tuple, every):
        if p in own or p in holds:
            continue
        k = next(i for i in range(len(p) - 1, -1, -1) if i == 0 or p[:i] in own)
        columns[outer(p[:k])]["_".join(p[k:])] = p[k:]
    named, names = {v: k for k, v in declared.items()}, {}
    out = []
    for path in sorted(columns, key=lambda x: (len(x), x)):
        above = [path[:i] for i in range(1, len(path)) if path[:i] in columns]
        cs = dict(columns[path])
        if path and ("$." + ".".join(path) in scalars or not cs):
            cs["_value" if "value" in cs else "value"] = ()
        near = above[-1] if above else ()
        names[path] = named.get(path) or "_".join(filter(None, (names.get(near, prefix), *path[len(near) :])))
        out.append(Table(names[path], path, tuple(names[x] for x in above), tuple(cs.items()), path in recursive))
    return out


def post_plan(raw: DataFrame, payload: str = "payload") -> Plan:
    """The plan of landed posts, derived from the schema graph of all payloads."""
    graph = schema_graph(raw, payload, "posts")
    root, *tables = _tables(_below_root(graph, "posts", OTHER_NAMES, False), DECLARED, "")
    _, *beside = _tables(_below_root(graph, "posts", {}, True), {}, "record")
    return Plan("post", "posts", (Table("post", (), (), root.columns), *tables), tuple(beside), tuple(OTHER_NAMES.items()), tuple((k, v) for k, (_, v) in LABELS.items()))


class _Shredder:
    """Lays the rows of the tables of a plan out of parsed payloads."""

    def __init__(self, plan: Plan):
        self.plan, self.other = plan, dict(plan.names)
        self.posts, self.beside = self._index(plan.tables), self._index(plan.beside)
        self.labels = dict(plan.labels)

    def _index(self, tables) -> dict[tuple[str, ...], Table]:
        return {t.path: t for t in tables}

    def rows(self, v):
        """(root ord, table, ords below the root, label, fields) of one payload."""
        v = _open(v)
        if type(v) not in (dict, list):
            return
        items = v
        if type(v) is dict and self.plan.member in v:
            items = v[self.plan.member]
            if self.beside:
                rest = {k: w for k, w in v.items() if k != self.plan.member}
                yield from self._walk(rest, (), (), self.beside, -1, None)
        items = _open(items)
        for i, e in enumerate(items if type(items) is list else () if items is None else (items,)):
            e = _open(e)
            if type(e) is dict:
                for a, b in self.other.items():
                    if a in e:
                        e = dict(e)
                        w = e.pop(a)
                        if e.get(b) is None:
                            e[b] = w
                fields: dict[str, str] = {}
                below = list(self._walk(e, (), (), self.posts, i, fields))
                yield i, self.plan.name, [], None, list(fields.items())
                yield from below

    def _walk(self, e: dict, path: tuple, ords: tuple, tables: dict, root: int, fields: dict | None, within: str = ""):
        for k, w in e.items():
            at = (*path, k)
            w = _open(w)
            t = tables.get(at)
            if t is None and k in path and (up := path[: path.index(k) + 1]) in tables:
                at, t = up, tables[up]  # an element below itself
            if t is not None:
                for i, x in enumerate(w if type(w) is list else () if w is None else (w,)):
                    if x is None:
                        continue
                    x = _open(x)
                    mine: dict[str, str] = {}
                    here = (*ords, i)
                    below = list(self._walk(x, at, here, tables, root, mine)) if type(x) is dict else []
                    if type(x) not in (dict, list):
                        mine[""] = _said(x)
                    yield root, t.name, list(here), self._label(t.name, x), list(mine.items())
                    yield from below
                if fields is not None and type(w) not in (dict, list) and w is not None:
                    fields[within + k] = _said(w)
            elif type(w) is dict:
                yield from self._walk(w, at, ords, tables, root, fields, f"{within}{k}.")
            elif type(w) is not list and fields is not None and w is not None:
                fields[within + k] = _said(w)

    def _label(self, name: str, x) -> str | None:
        ways = self.labels.get(name)
        if ways is None:
            return None
        for way in ways:
            v = x
            for k in way:
                v = _open(v.get(k)) if type(v) is dict else None
            if (said := _said(v)) is not None:
                return said
        return ""


def shred(df: DataFrame, keys: list[str], payload: str, plan: Plan) -> dict[str, DataFrame]:
    """One table for each of the plan, in the shared folder.

    A table has the caller's ``keys``, ``<root>_ord`` (the root element's place in the payload)
    and ``<table>_ord`` for each table above (the foreign key), its own ``<name>_ord`` (the place
    in its list, nulls counted) and the inlined columns; a recursive table has ``<name>_ords``,
    the places from its outermost element down, of which all but the last lead to the parent.
    The payloads are parsed once; all rows are written in one pass, a folder for each table.
    """
    kinds = pa.map_(pa.string(), pa.string())
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Shredder(plan)
        for b in batches:
            rows: list[tuple] = []

            def flush(rows: list[tuple], b: pa.RecordBatch = b) -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [b.column(i).take(at) for i in range(n)]
                types = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), kinds)
                columns += [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)]
                return pa.RecordBatch.from_arrays(columns, names=[*keys, "_root", "_table", "_ords", "_label", "_fields"])

            for i, said in enumerate(b.column(n).to_pylist()):
                if (v := _parsed(said)) is not None:
                    try:
                        rows += [(i, *r) for r in made.rows(v)]
                    except RecursionError:  # nested deeper than any list of replies
                        continue
                if len(rows) >= BATCH_ROWS:
                    yield flush(rows)
                    rows = []
            if rows:
                yield flush(rows)

    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string("_root int, _table string, _ords array<int>, _label string, _fields map<string,string>").fields])
    path = scratch(df.sparkSession, plan.name)
    df.select(*keys, payload).where(F.col(payload).isNotNull()).mapInArrow(run, schema).write.partitionBy("_table").parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    out: dict[str, DataFrame] = {}
    for t in (*plan.tables, *plan.beside):
        ords = [F.col("_ords")[i].alias(f"{a}_ord") for i, a in enumerate(t.above)]
        own = [] if t.name == plan.name else [F.element_at("_ords", -1).alias(f"{t.name}_ord")]
        if t.recursive:
            own.append(F.slice("_ords", len(t.above) + 1, F.size("_ords")).alias(f"{t.name}_ords"))
        label = [F.col("_label").alias("label")] if t.name in dict(plan.labels) else []
        taken = {*keys, f"{plan.name}_ord", "label", *(f"{a}_ord" for a in (*t.above, t.name))}
        columns = [F.element_at("_fields", F.lit(".".join(way))).alias(name if name not in taken else f"{name}_value") for name, way in t.columns]
        out[t.name] = stored.where(F.col("_table") == t.name).select(*keys, F.col("_root").alias(f"{plan.name}_ord"), *ords, *own, *label, *columns)
    return out


def post_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of landed posts, keyed by rec_id."""
    return shred(raw, ["rec_id"], "payload", post_plan(raw))


def child_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The child tables in one long form: (rec_id, post_ord, child, parent_ord, ord, label).

    A reply to a reply names the comment above both."""
    parts = []
    for name, (above, _) in LABELS.items():
        parent = F.col(f"{above}_ord") if above else F.lit(-1)
        parts.append(tables[name].select("rec_id", "post_ord", F.lit(name).alias("child"), parent.alias("parent_ord"), F.col(f"{name}_ord").alias("ord"), F.coalesce(F.col("label"), F.lit("")).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p3_found(raw: DataFrame) -> DataFrame:
    """(rec_id, post_ord, child, parent_ord, ord, label): one row for each non-null element."""
    return child_rows(post_tables(raw))
