"""Pipelines as JSON: a list of typed steps, checked before anything runs and folded into one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions.packs import PATTERN_PACKS
from annolake.operators import detect, labels, resolve
from annolake.schema import documents, exploded


@dataclass(frozen=True)
class Step:
    """``options``: names that a configuration may have. ``emits`` and ``maps``: what labels come out, from the
    configuration and those that came in."""

    build: object
    options: frozenset
    emits: object = field(default=lambda config, known: known)


REGISTRY: dict[str, Step] = {}


def register(name: str, build, options=(), emits=None) -> None:
    """P1."""
    REGISTRY[name] = Step(build, frozenset(options), emits or (lambda config, known: known))


def _regex_labels(config, known):
    found = set(PATTERN_PACKS[config.get("pack", "clinical_phi")]) if isinstance(config.get("pack", "clinical_phi"), str) else set(config["pack"])
    for label, how in (config.get("labels") or {}).items():
        found.discard(label)
        if how.get("enabled", True):
            found.add(how.get("remap") or label)
    return known | found


def _filtered(config, known):
    return known & set(config["keep"]) if config.get("keep") else known - set(config.get("drop") or ())


def _mapped(config, known):
    m = config.get("mapping") or {}
    return {m.get(x, x) for x in known if (x in m or not config.get("drop_unmapped"))} - {None}


register("regex_ner", lambda c: lambda d: detect.regex_ner(d, **c), ("pack", "labels", "dedupe", "skip_overlapping", "source", "flags"), _regex_labels)
register("whitelist", lambda c: lambda d: detect.whitelist(d, **c), ("terms", "skip_overlapping", "source"), lambda c, k: k | set(c.get("terms") or ()))
register("blacklist", lambda c: lambda d: detect.blacklist(d, **c), ("terms", "match", "patterns", "labels"))
register("label_filter", lambda c: lambda d: labels.filter_labels(d, **c), ("drop", "keep"), _filtered)
register("label_mapper", lambda c: lambda d: labels.map_labels(d, **c), ("mapping", "drop_unmapped"), _mapped)
register("resolve_spans", lambda c: lambda d: resolve.resolve(d, **c), ("strategy", "threshold", "groups", "ranking"))
register("consistency_propagator", lambda c: lambda d: detect.propagate(d, **c), ("min_confidence", "labels", "case_sensitive", "source"))
register("pipeline", lambda c: lambda d: run(d, c), ("pipes",), lambda c, k: output_labels(c, k))


def validate(config: dict) -> list[str]:
    """What is wrong with a configuration, without building it."""
    if not isinstance(config.get("pipes"), list):
        return ["a pipeline needs a list of pipes"]
    wrong = []
    for i, p in enumerate(config["pipes"]):
        step = REGISTRY.get(p.get("type"))
        if step is None:
            wrong.append(f"pipe {i}: unknown type {p.get('type')!r}; known: {sorted(REGISTRY)}")
            continue
        c = p.get("config") or {}
        if extra := sorted(set(c) - step.options):
            wrong.append(f"pipe {i}: {p['type']} has no options {extra}")
        if p["type"] == "label_filter" and bool(c.get("drop")) == bool(c.get("keep")):
            wrong.append(f"pipe {i}: label_filter takes drop or keep")
        if p["type"] == "resolve_spans" and c.get("strategy", "exact_dedupe") not in set(resolve.STRATEGIES) - {"union"}:
            wrong.append(f"pipe {i}: unknown strategy {c.get('strategy')!r}")
        if p["type"] == "pipeline":
            wrong += [f"pipe {i}: {w}" for w in validate(c)]
    return wrong


def steps(config: dict) -> list:
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))
    return [(p["type"], REGISTRY[p["type"]].build(p.get("config") or {})) for p in config["pipes"]]


def run(docs: DataFrame, config: dict) -> DataFrame:
    """All steps over documents, as one plan."""
    return reduce(lambda d, s: s[1](d), steps(config), documents(docs))


def trace(docs: DataFrame, config: dict) -> DataFrame:
    """(step, type, doc_id, start, end, label) after each step. All steps are one plan over one scan: each document's
    spans after every step are kept beside it and exploded together."""
    d, kept = documents(docs), []
    for i, (name, f) in enumerate(steps(config)):
        d = f(d)
        kept.append((f"__step{i}", i, name))
        d = d.withColumn(f"__step{i}", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    if not kept:
        return d.sparkSession.createDataFrame([], "step int, type string, doc_id string, start int, end int, label string")
    marked = lambda c, i, name: F.transform(c, lambda s: F.struct(F.lit(i).alias("step"), F.lit(name).alias("type"), s.alias("s")))
    every = F.flatten(F.array(*[marked(*k) for k in kept]))
    return exploded(d, ["doc_id"], every, "n", "x").select("x.step", "x.type", "doc_id", "x.s.start", "x.s.end", "x.s.label")


def output_labels(config: dict, known: set | None = None, upto: int | None = None) -> set[str]:
    """The labels that a pipeline, or its first ``upto`` steps, can give."""
    known = set(known or ())
    for p in config["pipes"][:upto]:
        known = REGISTRY[p["type"]].emits(p.get("config") or {}, known)
    return known


def lint(config: dict) -> list[str]:
    """Orders of steps that hardly make sense."""
    types = [p["type"] for p in config["pipes"]]
    notes = []
    finders = {"regex_ner", "whitelist", "consistency_propagator"}
    for i, t in enumerate(types):
        if t in ("blacklist", "label_filter", "resolve_spans", "label_mapper", "consistency_propagator") and not finders & set(types[:i]):
            notes.append(f"{t} comes before any detector")
        if t == "resolve_spans" and finders & set(types[i + 1 :]):
            notes.append("spans are resolved before a later detector adds more")
    return notes


def dump(config: dict) -> str:
    return json.dumps({"pipes": [{"type": p["type"], "config": p.get("config") or {}} for p in config["pipes"]]}, indent=1, sort_keys=True)


def load(text: str) -> dict:
    config = json.loads(text)
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))
    return config


def profile(name: str) -> dict:
    """Fast: patterns and a longest-first resolve; balanced and accurate add what needs no model."""
    base = [{"type": "regex_ner", "config": {"pack": "clinical_phi"}}]
    tail = {
        "fast": [{"type": "resolve_spans", "config": {"strategy": "longest_non_overlapping"}}],
        "balanced": [{"type": "resolve_spans", "config": {"strategy": "longest_non_overlapping"}}],
        "accurate": [{"type": "consistency_propagator"}, {"type": "resolve_spans", "config": {"strategy": "max_confidence"}}],
    }
    if name not in tail:
        raise KeyError(f"no profile {name!r}; known: {sorted(tail)}")
    return {"pipes": base + tail[name]}


@dataclass(frozen=True)
class Modes:
    """Names, and aliases, that may be run."""

    pipelines: dict[str, dict]
    aliases: dict[str, str] = field(default_factory=dict)
    allowed: tuple[str, ...] | None = None

    def resolve(self, name: str) -> dict:
        name = self.aliases.get(name, name)
        if self.allowed is not None and name not in self.allowed:
            raise PermissionError(f"mode {name!r} is not allowed")
        if name not in self.pipelines:
            raise KeyError(f"no mode {name!r}; known: {sorted(self.pipelines)}")
        return self.pipelines[name]

    def missing(self) -> dict[str, list[str]]:
        return {k: w for k, v in self.pipelines.items() if (w := validate(v))}
