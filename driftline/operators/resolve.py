"""From what files say to links between them: candidate paths first, then unique symbols.

Candidates are listed in order of preference, joined to the live paths, and the
first that exists wins. A name defined in exactly one other file resolves to it;
an ambiguous name to nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.sources.store import shared_table, small, tasks

EXACT, SYMBOL, GUESS = 0, 1, 2
IMPORT, CALL, TYPEREF, DOCREF, REEXPORT = 0, 1, 2, 3, 4
#: Ranges of commits by which package imports meet the files of their package.
RANGES = 256
#: Links of a package import that a task's share of work is reckoned by; none is left out.
LINKS = 64
_SCRIPT_ENDS = tuple(f".{e}" for e in "ts tsx d.ts js jsx mjs cjs coffee".split())
_SCRIPT_INDEX = tuple(f"index.{e}" for e in "ts tsx js jsx coffee".split())
#: What a compiler emits, and what it may come from.
_EMITTED = tuple(tuple(f".{e}" for e in pair.split("<")) for pair in "js<ts jsx<tsx mjs<mts cjs<cts js<coffee".split())

#: A reference; `candidates` begin with a null that stands for the reference itself.
_REFS = T.StructType([
    T.StructField("src", T.LongType()), T.StructField("commit_id", T.LongType()), T.StructField("ref", T.LongType()),
        T.StructField("kind", T.IntegerType()), T.StructField("internal", T.BooleanType()), T.StructField("last", T.StringType()),
    T.StructField("package", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("resolutions", T.ArrayType(T.IntegerType())),
])
_TOLD = ("src", "commit_id", "path", "lang", "imports", "doc_links")


class Manifests:
    """The Go module and the crates' source folders as of any commit.

    `changes`: (commit, module or None, crate or None, folder), one for each time a
    manifest changed; a later one replaces an earlier one of the same name.
    """

    def __init__(self, changes: Iterable[tuple[int, str | None, str | None, str | None]] = ()) -> None:
        self.changes = sorted(changes, key=lambda c: c[0])
        self.at = [c[0] for c in self.changes]
        self._fold = lru_cache(maxsize=64)(self._first)

    def _first(self, n: int) -> tuple[str | None, dict[str, str]]:
        module, crates = None, {}
        for _, m, name, folder in self.changes[:n]:
            module = m or module
            if name:
                crates[name] = folder
        return module, crates

    def as_of(self, commit: int) -> tuple[str | None, dict[str, str]]:
        return self._fold(bisect_right(self.at, commit))

    def __reduce__(self) -> tuple:
        return Manifests, (self.changes,)


def normal(path: str) -> str:
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            del out[-1:]
        elif p and p != ".":
            out.append(p)
    return "/".join(out)


def join(directory: str, name: str) -> str:
    return f"{directory}/{name}" if directory else name


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def _script(path: str, spec: str) -> list[tuple[str, int]]:
    def base(p: str, res: int) -> list[tuple[str, int]]:
        p = normal(p)
        out = [p, *(p.removesuffix(a) + b for a, b in _EMITTED if p.endswith(a)), *(p + e for e in _SCRIPT_ENDS), *(join(p, i) for i in _SCRIPT_INDEX)]
        return [(x, res) for x in out]

    if spec in (".", "..") or spec.startswith(("./", "../")):
        return base(join(parent(path), spec), EXACT)
    return base(spec, GUESS) + base(f"src/{spec}", GUESS)


def _python(path: str, spec: str, package_root: str | None) -> list[tuple[str, int]]:
    def base(p: str, res: int) -> list[tuple[str, int]]:
        p = normal(p)
        return [(f"{p}.py", res), (join(p, "__init__.py"), res)] if p else []

    if spec.startswith("."):
        rest = spec[1:].lstrip(".")
        d = parent(path)
        for _ in range(len(spec) - len(rest) - 1):
            d = parent(d)
        return base(join(d, rest.replace(".", "/")), EXACT) if rest else [(join(d, "__init__.py"), EXACT)]
    p = spec.replace(".", "/")
    return base(p, EXACT) + base(f"src/{p}", EXACT) + (base(join(package_root, p), GUESS) if package_root is not None else [])


def _ruby(path: str, spec: str) -> list[tuple[str, int]]:
    def base(p: str, res: int) -> list[tuple[str, int]]:
        p = normal(p)
        return [(p if p.endswith(".rb") else f"{p}.rb", res)] if p else []

    if spec.startswith("rel:"):
        return base(join(parent(path), spec[4:]), EXACT)
    return base(f"lib/{spec}", EXACT) + base(spec, GUESS)


def _rust(path: str, spec: str, crate_root: str | None, crates: dict[str, str]) -> list[tuple[str, int]]:
    d = parent(path)
    if spec.startswith("mod:"):
        n, stem = spec[4:], path.rpartition("/")[2].split(".")[0]
        return [(normal(join(d, c)), EXACT) for c in (f"{n}.rs", f"{n}/mod.rs", f"{stem}/{n}.rs")]
    segs = [s for s in spec.split("::") if s]
    if not segs or segs[0] in ("std", "core", "alloc"):
        return []
    rooted = False
    if segs[0] == "crate":
        if crate_root is None:
            return []
        root, body, rooted = crate_root, segs[1:], True
    elif segs[0] == "self":
        root, body = d, segs[1:]
    elif segs[0] == "super":
        n = next((i for i, s in enumerate(segs) if s != "super"), len(segs))
        root, body = d, segs[n:]
        for _ in range(n):
            root = parent(root)
    elif (name := segs[0].replace("-", "_")) in crates:
        root, body, rooted = crates[name], segs[1:], True
    else:
        return []
    out = [(normal(join(root, f"{'/'.join(body[:k])}{end}")), EXACT) for k in range(len(body), 0, -1) for end in (".rs", "/mod.rs")]
    if rooted and len(body) <= 1:
        out += [(join(root, "lib.rs"), EXACT), (join(root, "main.rs"), EXACT)]
    return [c for c in out if c[0] != path]


def _go_package(path: str, spec: str, module: str | None) -> str | None:
    if module and spec == module:
        return ""
    if module and spec.startswith(f"{module}/"):
        return spec[len(module) + 1 :]
    return normal(join(parent(path), spec)) if spec.startswith("./") else None


def internal(lang: str, spec: str, module: str | None, crates: dict[str, str]) -> bool:
    """Whether a specifier looks like one of the repository's own; only those count for import health."""
    if lang in ("ts", "tsx", "js", "py", "coffee"):
        return spec.startswith(".")
    if lang == "rb":
        return spec.startswith("rel:")
    if lang == "rust":
        first = spec.split("::")[0]
        return spec.startswith("mod:") or first in ("crate", "self", "super") or first.replace("-", "_") in crates
    return lang == "go" and (spec.startswith("./") or bool(module) and (spec == module or spec.startswith(f"{module}/")))


def _ancestors(path: Column) -> Column:
    """Folders of a path from its own up to the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _holds(start: str = "from_commit", end: str = "to_commit") -> Column:
    return (F.col(start) <= F.col("commit_id")) & (F.col(end).isNull() | (F.col(end) > F.col("commit_id")))


def with_roots(sources: DataFrame, live: DataFrame) -> DataFrame:
    """Adds package_root and crate_root from what lay in the folders above each source (src, commit_id, path, lang, ...)."""
    at = small(live.select("from_commit", "to_commit", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.substring_index("path", "/", -1).alias("name")).where(F.col("name").isin("__init__.py", "lib.rs", "main.rs")))
    up = sources.where(F.col("lang").isin("py", "rust")).select("src", "commit_id", F.posexplode(_ancestors(F.col("path"))).alias("n", "dir"))
    marks = up.join(at, "dir").where(_holds()).groupBy("src", "commit_id").agg(F.collect_set(F.when(F.col("name") == "__init__.py", F.col("n"))).alias("py"),
        F.min(F.when(F.col("name") != "__init__.py", F.col("n"))).alias("crate_at"))
    folders = _ancestors(F.col("path"))
    top = F.size(folders) - 1
    # The first folder upward without the mark of a package, or the root.
    outs = F.filter(F.sequence(F.lit(0), top), lambda n: (n == top) | ~F.array_contains(F.coalesce("py", F.array().cast("array<int>")), n))
    first_out = F.array_min(outs)
    return sources.join(small(shared_table(marks)), ["src", "commit_id"], "left").withColumns({
        "package_root": F.when(first_out > 0, F.element_at(folders, first_out + 1)),
        "crate_root": F.when(F.col("crate_at").isNotNull(), F.element_at(folders, F.col("crate_at") + 1)),
    }).drop("py", "crate_at")


def _references(batches: Iterator[pa.RecordBatch], manifests: Manifests) -> Iterator[pa.RecordBatch]:
    """Rows of _REFS: what each source refers to, and where that may lie."""
    schema = to_arrow_schema(_REFS)
    for b in batches:
        out: list[tuple] = []
        for src, commit, path, lang, imports, links, package, crate in zip(*(c.to_pylist() for c in b.columns), strict=True):
            module, crates = manifests.as_of(commit)
            n = 0
            for i in imports or [] if lang != "md" else []:
                spec = i["spec"]
                if not spec:
                    continue
                n += 1
                own, where = internal(lang, spec, module, crates), None
                options = _script(path, spec) if lang in ("ts", "tsx", "js", "coffee") else _python(path, spec,
                    package) if lang == "py" else _ruby(path, spec) if lang == "rb" else _rust(path, spec, crate, crates) if lang == "rust" else []
                last = spec.replace(".", ":").replace("/", ":").rsplit(":", 1)[-1]
                if lang == "go":
                    where, last = _go_package(path, spec, module), ""
                out.append((src, commit, n, REEXPORT if i["reexport"] else IMPORT, own, last if len(last) >= 3 and last != "*" else None, where,
                    [None, *(c for c, _ in options)], [None, *(r for _, r in options)]))
            for link in links or [] if lang == "md" else []:
                n += 1
                options = [c for c in (normal(join(parent(path), link)), normal(link))]
                out.append((src, commit, n, DOCREF, True, None, None, [None, *(c or None for c in options)], [None, *([EXACT] * len(options))]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _package_links(asks: DataFrame, live: DataFrame, exact: DataFrame) -> DataFrame:
    """(src, commit_id, dst, kind, resolution): every file that lay in an imported package, unless the source has an exacter link of that kind to it.

    Imports and files meet by package and range of commits, so that each import looks
    at little more than it links to. The links, which are many, aren't shuffled.
    """
    key = ["src", "commit_id", "kind"]
    n = tasks(asks.sparkSession, LINKS * asks.count())
    asks = asks.select(*key, "package").distinct()
    known = exact.join(asks.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.collect_set("dst").alias("known"))
    last = asks.agg(F.max("commit_id").alias("last"))
    range_of = lambda c: F.floor(c * RANGES / (F.col("last") + 1))
    asks = asks.join(known, key, "left").join(F.broadcast(last)).withColumn("range", range_of(F.col("commit_id")))
    spans = _package_files(live).join(F.broadcast(last)).where(F.col("from_commit") <= F.col("last"))
    until = F.least(F.coalesce(F.col("to_commit"), F.col("last")), F.col("last"))
    spans = spans.withColumn("range", F.explode(F.sequence(range_of(F.col("from_commit")), range_of(until)))).drop("last")
    met = asks.drop("last").repartition(n, "package", "range").join(spans.repartition(n, "package", "range"), ["package", "range"]).where(_holds() & (F.col("src") != F.col("dst")))
    new = F.coalesce(~F.array_contains("known", F.col("dst")), F.lit(True))
    return met.where(new).select("src", "commit_id", "dst", "kind", F.lit(GUESS).alias("resolution"))


def _package_files(live: DataFrame) -> DataFrame:
    return live.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("file_id").alias("dst"),
        "from_commit", "to_commit", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("package"))


def _held_packages(asks: DataFrame, live: DataFrame) -> DataFrame:
    """(commit_id, package) of `asks` in which a file lay: a running count of files that come and go."""
    files = _package_files(live)
    moves = files.select("package", F.col("from_commit").alias("commit_id"), F.lit(1).alias("by")).union(
        files.where("to_commit IS NOT NULL").select("package", "to_commit", F.lit(-1)))
    # A range frame takes in all that happens at the commit itself.
    events = moves.groupBy("package", "commit_id").agg(F.sum("by").alias("by")).withColumn("asked", F.lit(False)).unionByName(
        asks.select("package", "commit_id").distinct().withColumns({"by": F.lit(0).cast("long"), "asked": F.lit(True)}))
    upto = Window.partitionBy("package").orderBy("commit_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("there", F.sum("by").over(upto)).where("asked AND there > 0").select("commit_id", "package")


def resolve(files: DataFrame, parsed: DataFrame, symbols: DataFrame, live: DataFrame, manifests: Manifests = Manifests()) -> tuple[DataFrame, DataFrame]:
    """(edges (src, commit_id, dst, kind, resolution), health (src, commit_id, imports_total, imports_resolved)).

    files (src, commit_id, path, lang, blob_oid): what to resolve, each as of its
    commit; parsed: `extract_blobs`; symbols (name, file_id, first_commit,
    last_commit) and live (file_id, path, from_commit, to_commit): what was defined
    and where files were, by commit. `manifests` has a row for each change of one and
    goes to every task. Of several ways to one link the most exact stays; none to itself.
    """
    told = shared_table(files.join(parsed.drop("lang"), "blob_oid").select(*_TOLD, "calls", "type_refs", "doc_tokens"))
    live = shared_table(live.select("file_id", "path", "from_commit", "to_commit"))
    placed = with_roots(told.select(*_TOLD), live).select(*_TOLD, "package_root", "crate_root")
    refs = placed.mapInArrow(lambda batches: _references(batches, manifests), _REFS)
    spread = refs.select("src", "commit_id", "ref", "kind", "internal", "last", "package", F.posexplode("candidates").alias("ordinal", "candidate"),
        "resolutions").withColumn("resolution", F.get("resolutions", F.col("ordinal"))).drop("resolutions")
    # Of the candidates only those stay that were ever a path; each is written with its reference's own row.
    ever = small(live.select(F.col("path").alias("candidate")).distinct()).withColumn("was", F.lit(True))
    own = F.col("ordinal") == 0
    about = ("kind", "internal", "last", "package")
    listed = shared_table(spread.join(ever, "candidate", "left").where(own | F.col("was")).drop("was").withColumns({c: F.when(own, F.col(c)) for c in about}))
    here = live.select(F.col("file_id").alias("dst"), F.col("path").alias("candidate"), "from_commit", "to_commit")
    ref = ["src", "commit_id", "ref"]
    hit = F.struct("ordinal", "dst", "resolution")
    hits = listed.where(~own).join(here, "candidate").where(_holds()).select(*ref, *(F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in about), hit.alias("hit"))
    heads = listed.where(own).select(*ref, *about, F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    asks = listed.where(own & F.col("package").isNotNull()).select(*ref, "kind", "package")
    held = _held_packages(asks, live).withColumn("held", F.lit(True))
    # Missed references look for their name; all are written once, as edges and health read them.
    found = shared_table(heads.union(hits).groupBy(*ref).agg(*(F.max(c).alias(c) for c in about), F.min("hit").alias("hit")))
    others = symbols.select("name", "file_id", "first_commit", "last_commit").distinct()

    def unique(asks: DataFrame) -> DataFrame:
        """Adds dst: the one other file that defines `name`."""
        keys = asks.columns
        hits = asks.join(others, "name").where((F.col("file_id") != F.col("src")) & _holds("first_commit", "last_commit")).groupBy(*keys)
        return hits.agg(F.min("file_id").alias("dst"), F.max("file_id").alias("most")).where("dst = most").drop("most")

    missed = found.where(F.col("hit").isNull() & F.col("last").isNotNull()).select("src", "commit_id", "ref", "kind", F.col("last").alias("name"))
    fallback = unique(missed)

    def used(names: Column, kind: int, resolution: int) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.lit(resolution).alias("resolution")))

    named = F.filter(F.transform(F.flatten("imports.names"), lambda n: F.element_at(F.split(n, r"\."), -1)), lambda n: F.length(n) >= 3)
    md = F.col("lang") == "md"
    uses = F.when(md, used(F.col("doc_tokens"), DOCREF, GUESS)).otherwise(F.concat(used(named, IMPORT, SYMBOL),
        used(F.col("calls"), CALL, SYMBOL), used(F.col("type_refs"), TYPEREF, SYMBOL)))
    uses = told.select("src", "commit_id", F.inline(uses)).distinct()
    exact = (
        found.where("hit IS NOT NULL").select("src", "commit_id", "hit.dst", "kind", "hit.resolution")
        .union(fallback.select("src", "commit_id", "dst", "kind", F.lit(SYMBOL))).union(unique(uses).select("src", "commit_id", "dst", "kind", "resolution"))
    )
    exact = exact.where("src <> dst").groupBy("src", "commit_id", "dst", "kind").agg(F.min("resolution").alias("resolution"))
    edges = exact.union(_package_links(asks, live, exact))
    settled = found.join(fallback.select(*ref, F.lit(True).alias("by_name")), ref, "left").join(held, ["commit_id", "package"], "left")
    got = F.col("hit").isNotNull() | F.col("held").isNotNull()
    counts = F.col("internal") | F.col("hit").isNotNull()
    health = settled.groupBy("src", "commit_id").agg(F.count_if(counts).alias("imports_total"),
        F.count_if(got & (counts | F.col("internal")) | (F.col("internal") & F.coalesce("by_name", F.lit(False)))).alias("imports_resolved"))
    return edges, health
