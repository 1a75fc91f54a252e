"""Commit classification and change normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import is_excluded_path
from driftline.functions.scalars import commit_weight, decay, days_between
from driftline.model import MECHANICAL, MERGE, TOO_LARGE
from driftline.params import Params

_MECHANICAL = r"(?i)^(fmt|lint|style|chore)\b|^bump\b|gofmt|rustfmt|prettier|reformat|alias migration|import.*reorder|rename.*import"
_TRIVIAL_LINES = ("", "{", ")", "}", ");", "};")
_SCRIPT = r"^(import[ {]|\} from |export .* from )|require\(|^.* from .*[,;]$"
_IMPORTS = {
    "ts": _SCRIPT, "tsx": _SCRIPT, "js": _SCRIPT, "py": r"^(import|from) ", "rust": r"^(pub(\(crate\))? )?use |^extern crate |^mod .*;$",
    "go": r'^import |^".*"$|^"$', "rb": r"^(require|require_relative)[ (]|^(load|autoload) ", "coffee": r"""^import |^export .* from |require\(|require ['"]""",
}


def mechanical_subject(subject: Column) -> Column:
    """Subjects of formatting, linting, version bumps and import shuffles."""
    return F.coalesce(subject.rlike(_MECHANICAL), F.lit(False))


def is_import_line(lang: Column, line: Column) -> Column:
    """Whether a trimmed source line only imports, by the rules of its language."""
    out = F.lit(False)
    for name, rule in _IMPORTS.items():
        out = F.when(lang == name, line.rlike(rule)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def import_only_fraction(lang: Column, lines: Column) -> Column:
    """Share of the considered lines that import; blank and bracket-only lines aren't considered; 0 if none is."""
    said = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.isin(*_TRIVIAL_LINES))
    hits = F.filter(said, lambda x: is_import_line(lang, x))
    return F.when(F.size(said) > 0, F.size(hits) / F.size(said)).otherwise(F.lit(0.0))


def import_only(lang: Column, lines: Column, p: Params) -> Column:
    return (F.size(lines) > 0) & (import_only_fraction(lang, lines) >= p.import_only_ratio)


def classify(commits: DataFrame, touches: DataFrame, p: Params) -> DataFrame:
    """Adds n_files, excluded (flags) and weight to every commit."""
    sizes = touches.groupBy(F.col("commit_id").alias("id")).agg(F.count("*").alias("n_files"), F.count_if("import_only").alias("n_import"))
    return flagged(commits.join(sizes, "id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0))), p)


def flagged(out: DataFrame, p: Params) -> DataFrame:
    """Adds excluded and weight to commits with n_files and n_import."""
    n = F.col("n_files")
    large = n > p.max_commit_files
    mechanical = (n > 5) & (mechanical_subject(F.col("subject")) | (F.coalesce(F.col("n_import"), F.lit(0)) / n > 0.9))
    flags = (
        F.when(large, F.lit(TOO_LARGE)).otherwise(F.lit(0)) + F.when(mechanical, F.lit(MECHANICAL)).otherwise(F.lit(0))
        + F.when(F.col("is_merge"), F.lit(MERGE)).otherwise(F.lit(0))
    ).cast("long")
    merged_out = F.col("is_merge") if p.exclude_merges else F.lit(False)
    out = out.withColumn("excluded", flags)
    return out.withColumn("weight", commit_weight(n, large | mechanical | merged_out)).drop("n_import")


def included(commits: DataFrame, p: Params, among: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(commit_id, author_time, weight, decayed, *also) of the commits that count; time is relative to the latest commit of all (of `among`, if given)."""
    now = (commits if among is None else among).agg(F.max("author_time").alias("now"))
    aged = commits.where("weight > 0").join(F.broadcast(now))
    return aged.select(
        F.col("id").alias("commit_id"), "author_time", "weight",
            (F.col("weight") * decay(days_between(F.col("now"), F.col("author_time")), p.half_life_days)).alias("decayed"), *also
    )


def normalize_changes(changes: DataFrame) -> DataFrame:
    """Drops changes of excluded paths; a rename across the border becomes an addition or a deletion.

    Columns change, path, old_path, new_blob. Adds `phase`, the order within a
    commit: deletions, renames, modifications, additions.
    """
    out, old = is_excluded_path(F.col("path")), F.coalesce(is_excluded_path(F.col("old_path")), F.lit(False))
    renamed = F.col("change") == "R"
    kept = changes.where(F.when(renamed, ~(out & old)).otherwise(~out))
    kind = F.when(renamed & old, F.lit("A")).when(renamed & out, F.lit("D")).otherwise(F.col("change"))
    path = F.when(renamed & out & ~old, F.col("old_path")).otherwise(F.col("path"))
    kept = kept.select(*[c for c in changes.columns if c not in ("change", "path", "old_path", "new_blob")], kind.alias("change"),
        path.alias("path"), F.when(kind == "R", F.col("old_path")).alias("old_path"), F.when(kind != "D", F.col("new_blob")).alias("new_blob"))
    return kept.withColumn("phase", F.array_position(F.array(*map(F.lit, "DRMA")), F.col("change")).cast("int"))
