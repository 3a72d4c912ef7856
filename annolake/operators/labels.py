"""Label filters, mappings and label spaces, risk weights as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.packs import LABEL_SPACES, LabelSpace


def filter_labels(docs: DataFrame, drop: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Drops or keeps labels; neither changes nothing, both are an error."""
    if drop and keep:
        raise ValueError("give drop or keep, not both")
    if keep:
        return docs.withColumn("spans", F.filter("spans", lambda s: s["label"].isin(list(keep))))
    return docs.withColumn("spans", F.filter("spans", lambda s: ~s["label"].isin(list(drop)))) if drop else docs


def mapped(spans: Column, mapping: dict[str, str | None], drop_unmapped: bool = False) -> Column:
    """Labels by ``mapping``; one that leads to None is dropped, others stay or, on request, go."""
    if not mapping:
        return spans
    gone = [k for k, v in mapping.items() if v is None]
    known = F.create_map(*[x for k, v in mapping.items() if v is not None for x in (F.lit(k), F.lit(v))]) if len(gone) < len(mapping) else None
    kept = F.filter(spans, lambda s: ~s["label"].isin(gone)) if gone else spans
    if drop_unmapped:
        kept = F.filter(kept, lambda s: s["label"].isin([k for k, v in mapping.items() if v is not None]))
    return kept if known is None else F.transform(kept, lambda s: s.withField("label", F.coalesce(known[s["label"]], s["label"])))


def map_labels(docs: DataFrame, mapping: dict[str, str | None], drop_unmapped: bool = False) -> DataFrame:
    """C3, C5, C15, M20."""
    return docs.withColumn("spans", mapped(F.col("spans"), mapping, drop_unmapped))


def normalise(label: Column, space: LabelSpace | str = "clinical_phi") -> Column:
    """Upper case, blanks and hyphens as underscores; the canonical label, what an alias leads to, or the fallback."""
    space = LABEL_SPACES[space] if isinstance(space, str) else space
    key = F.upper(F.translate(label, " -", "__"))
    known = {**space.aliases, **{x: x for x in space.labels}}
    return F.coalesce(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])[key], F.lit(space.fallback))


def normalise_labels(docs: DataFrame, space: LabelSpace | str = "clinical_phi") -> DataFrame:
    return docs.withColumn("spans", F.transform("spans", lambda s: s.withField("label", normalise(s["label"], space))))


def weight(label: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """A label's risk weight."""
    if not weights:
        return F.lit(default)
    return F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[label], F.lit(default))
