"""Settings: layered values, plans of experiments and of resets, policies. Plain functions of dictionaries; nothing here is a table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

#: The columns of an experiment's summary in their order.
SUMMARY = (
    "run_name run_id output_root chunking_strategy chunking_augmentation embedding_provider embedding_model llm_provider llm_model "
    "contextual_llm_provider contextual_llm_model contextual_max_doc_chars late_chunk_adapter late_chunk_embedding_model "
    "started_at completed_at duration_seconds file_count chunk_count cluster_count profile_count centroid_count"
).split()
#: The settings of a run and their defaults.
RUN_DEFAULTS = {
    "output_root": "data/phase_a", "chunking_strategy": "recursive", "chunking_augmentation": "none", "embedding_provider": "ollama", "embedding_model": "", "llm_provider": "ollama", "llm_model": "",
    "contextual_llm_provider": "", "contextual_llm_model": "", "contextual_max_doc_chars": "4000", "late_chunk_adapter": "retrieval.passage", "late_chunk_embedding_model": "",
}
#: The providers that a profile stands for: (language model, embeddings).
PROFILES = {"local": ("ollama", "ollama"), "groq": ("groq", "ollama"), "mac-metal": ("fastapi", "fastapi")}


def read_settings(path: str) -> dict[str, str]:
    """The ``KEY=value`` lines of a file; comments, ``export`` and quotes are understood; no file gives nothing."""
    out, file = {}, Path(path)
    for line in file.read_text("utf-8").splitlines() if file.is_file() else ():
        line = line.strip().removeprefix("export ")
        name, mark, value = line.partition("=")
        if mark and not line.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value.split(" #")[0].strip()
    return out


def layered(process: dict[str, str], *files: str) -> dict[str, str]:
    """The process's values, overlaid by each file in turn: what stands in a later file wins."""
    out = dict(process)
    for f in files:
        out |= read_settings(f)
    return out


def csv(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def run_plan(settings: dict[str, str], prefix: str = "PHASE_A") -> list[dict]:
    """The runs of an experiment matrix: each named run's own settings over the plan's defaults."""
    names = csv(settings.get(f"{prefix}_RUNS"))
    if not names:
        raise ValueError(f"{prefix}_RUNS must name the runs")
    plan = []
    for name in names:
        run = {"run_name": name, "run_id": settings.get(f"{prefix}_RUN_{name}_RUN_ID", name)}
        for key, value in RUN_DEFAULTS.items():
            run[key] = settings.get(f"{prefix}_RUN_{name}_{key.upper()}", settings.get(f"{prefix}_DEFAULT_{key.upper()}", value))
        run["contextual_llm_provider"] = run["contextual_llm_provider"] or run["llm_provider"]
        run["contextual_max_doc_chars"] = int(run["contextual_max_doc_chars"])
        plan.append(run)
    return plan


def run_summary(run: dict, measured: dict) -> dict:
    """A run's settings and measurements in the summary's order; what is missing is None."""
    return {k: measured.get(k, run.get(k)) for k in SUMMARY}


def snapshot(settings: dict[str, str], path: str, prefixes: tuple[str, ...] = ("PHASE_A_",)) -> None:
    """The settings of a run as sorted JSON in a file."""
    Path(path).write_text(json.dumps({k: settings[k] for k in sorted(settings) if k.startswith(prefixes)}, indent=2), "utf-8")


@dataclass
class ResetOptions:
    """What is to be cleared: sources (vault, email, pdf), with or without their stored vectors, and named tables."""

    env: str = "dev"
    vault: bool = False
    email: bool = False
    pdf: bool = False
    vectors: bool = False
    collections: list[str] = field(default_factory=list)
    relational: bool = False
    tables: list[str] = field(default_factory=list)
    force: bool = False
    dry_run: bool = False


#: Per source the state that it keeps, the collection of its chunks, the kind of chunk there, and that of its centroids.
SOURCES = {"vault": ("ingestion_state", "TheMuses", None, "ClusterCentroid"), "email": ("email_state", "TheLethe", "email", "ClusterCentroidLethe"), "pdf": ("pdf_state", "TheLethe", "pdf", "ClusterCentroidLethe")}


def reset_plan(options: ResetOptions) -> list[tuple[str, str, str | None]]:
    """(action, target, kind of rows) in order. Raises where options contradict each other or nothing is to be cleared."""
    if options.tables and not options.relational:
        raise ValueError("tables are named but the relational store isn't to be cleared")
    if options.collections and not options.vectors:
        raise ValueError("collections are named but the vector store isn't to be cleared")
    if options.env in ("staging", "prod") and not (options.force or options.dry_run):
        raise ValueError("staging and prod need force")
    chosen = [s for s in SOURCES if getattr(options, s)]
    if not (chosen or options.collections or options.tables):
        raise ValueError("nothing to clear")
    plan: list[tuple[str, str, str | None]] = []
    for source in chosen:
        kept, chunks, kind, centroids = SOURCES[source]
        plan.append(("delete_file", kept, None))
        if options.vectors:
            plan += [("delete_rows", chunks, kind) if kind else ("delete_table", chunks, None), ("delete_table", centroids, None)]
    return plan + [("delete_table", c, None) for c in options.collections] + [("truncate", t, None) for t in options.tables]


def providers(profile: str = "local", llm: str | None = None, embedding: str | None = None) -> tuple[str, str]:
    """The providers (language model, embeddings): those named, else the profile's, else the local ones."""
    own = PROFILES.get(profile, PROFILES["local"])
    return llm or own[0], embedding or own[1]


class StrictJson:
    """Which steps insist on JSON answers: named ones, or all by ``*`` or ``all``."""

    def __init__(self, steps: str = "", fallback: str = "false"):
        named = {self._plain(x) for part in steps.split(",") for x in part.split()}
        self.steps, self.fallback = {"*"} if named & {"*", "all"} else named, fallback.strip().lower() in ("1", "true", "yes", "on")

    @staticmethod
    def _plain(step: str) -> str:
        return step.strip().lower().replace("-", "_")

    def strict(self, step: str) -> bool:
        return "*" in self.steps or self._plain(step) in self.steps
