"""The stages of a corpus build, each from frames to named frames, and reports from their summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, extract, prepare, vectors


@dataclass(frozen=True)
class StageResult:
    """Named frames, all lazy, and the frames (of few rows) that a summary is made of."""

    frames: dict[str, DataFrame]
    figures: dict[str, DataFrame] = field(default_factory=dict)
    #: Names of frames in order whose first rows a report shows.
    shown: tuple[str, ...] = ()

    def summary(self) -> dict:
        """The figures as plain values; this is what runs them."""
        return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in self.figures.items()}

    def previews(self, n: int = 5) -> dict[str, list[dict]]:
        """The first rows of each frame that is in order."""
        return {name: [r.asDict() for r in self.frames[name].limit(n).collect()] for name in self.shown}

    def report(self, summary: dict | None = None) -> str:
        """The summary as text: counts with their share of the figure's sum, then the first rows of frames in order."""
        out = []
        for name, rows in (summary or self.summary()).items():
            out.append(f"== {name}")
            counts = [r.get("n", r.get("count")) for r in rows]
            total = sum(counts) if len(rows) > 1 and all(isinstance(c, int) for c in counts) else 0
            out += ["  " + ", ".join(f"{k}: {v}" for k, v in r.items()) + (f" ({100 * c / total:.1f} %)" if total else "") for r, c in zip(rows, counts)]
        for name, rows in self.previews().items():
            out += [f"== first of {name}", *("  " + ", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows)]
        return "\n".join(out)


def _rows(**frames: DataFrame) -> dict[str, DataFrame]:
    return {f"{n}_rows": df.agg(F.count("*").alias("n")) for n, df in frames.items()}


def extract_stage(lines: DataFrame) -> StageResult:
    pairs = extract.parallel_table(extract.numbered_items(lines)).orderBy("texto_id", "item_number", "doc_id")
    return StageResult({"pairs": pairs}, {**_rows(pairs=pairs), "quality": extract.flag_counts(pairs).orderBy(F.desc("n"), "quality_flag")}, ("pairs",))


def filter_stage(raw: DataFrame) -> StageResult:
    valid, removed = prepare.route(raw)
    return StageResult({"valid": valid, "removed": removed}, {**_rows(valid=valid, removed=removed), "reasons": removed.groupBy("removal_reason").count().orderBy(F.desc("count"))})


def unify_stage(concatenated: DataFrame) -> StageResult:
    unified = prepare.unify(concatenated)
    crossed = prepare.cross_duplicates(unified).orderBy("duplicate_group", "source", "pair_id")
    return StageResult({"unified": unified, "cross_duplicates": crossed}, {**_rows(unified=unified, cross_duplicates=crossed), "sources": unified.groupBy("source").count().orderBy("source")}, ("cross_duplicates",))


def normalize_stage(unified: DataFrame, rules: list[str] | dict | None = None) -> StageResult:
    normalized, log = prepare.normalize(unified, rules)
    removed = unified.sparkSession.createDataFrame([], "pair_id string, ESP_original string, SHIWILU_original string, removal_reason string")
    changed = log.agg(F.countDistinct("pair_id").alias("rows_changed"), F.count("*").alias("transformations"))
    return StageResult({"normalized": normalized, "log": log, "removed": removed}, {**_rows(normalized=normalized), "changes": changed, "by_rule": log.groupBy("rule_name").count().orderBy("rule_name"), "by_column": log.groupBy("column").count().orderBy("column")})


def audit_stage(normalized: DataFrame) -> StageResult:
    """The normalized table feeds five checks; persist it first where it is costly."""
    problems = audit.all_problems(normalized)
    frames = {"problems": audit.consolidated(problems), "final": audit.flagged(normalized)}
    return StageResult(frames, {**_rows(normalized=normalized), "by_type": audit.by_type(problems).orderBy("problem_type"), "duplicates": audit.duplicate_stats(normalized), "lengths": audit.length_stats(normalized)})


def compare_stage(scores: DataFrame, key: str, threshold: float = 0.3) -> StageResult:
    low = vectors.below(scores, threshold).orderBy("similarity_score", key)
    return StageResult({"low_similarity": low, "extremes": vectors.extremes(scores, key)}, {**_rows(scores=scores, low_similarity=low), "distribution": vectors.distribution(scores), "percentiles": vectors.percentiles(scores)}, ("low_similarity",))
