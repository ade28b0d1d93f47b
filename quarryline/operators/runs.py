"""Gates and checks of runs: sources, shares, captures, manifests, statuses and paths.

Tables are checked by expressions; control records, which are small by nature, as dictionaries. Each
check names what is wrong; none of them stops at the first problem.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run.
STATES = ("RUNNING", "CHECKPOINTING", "INTERRUPTED", "FAILED", "COMPLETED")


def blocking_sources(registry: DataFrame, used: DataFrame) -> DataFrame:
    """source, target_share of sources in use with a share that production isn't approved for."""
    active = registry.where((F.col("target_share") > 0) & ~F.coalesce("production_approved", F.lit(False)))
    return active.join(used.select("source").distinct(), "source", "left_semi").select("source", "target_share")


def share_sums(rows: DataFrame, by: str, share: str) -> DataFrame:
    """by, total, whether it is exactly 1, and whether it is within 1e-9 of 1."""
    total = rows.groupBy(by).agg(F.sum(share).alias("total"))
    return total.select(by, "total", (F.col("total") == 1).alias("exact"), (F.abs(F.col("total").cast("double") - 1) <= 1e-9).alias("near"))


def merged(first: Column, later: Column) -> Column:
    """Two maps as one; of a key in both the later value counts."""
    return F.map_zip_with(first, later, lambda k, a, b: F.when(F.map_contains_key(later, k), b).otherwise(a))


def first_present(m: Column, *keys: str) -> Column:
    """The value of the first key that the map has."""
    chosen = F.when(F.lit(False), F.lit(None))
    for k in keys:
        chosen = chosen.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k)))
    return chosen


def capture_issues(rows: DataFrame, model: str, digest: str, wrong_size: Column, sampling: Sequence[str]) -> Column:
    """What is wrong with captured records (model_id, ui_model_id, digest and sampling fields), joined by commas."""
    same = lambda a, b: F.col(a).eqNullSafe(b)
    needed = [F.when(F.col(c).isNull(), f"missing_field:{c}") for c in ("model_id", "ui_model_id", "digest") if c in rows.columns]
    found = [
        *needed,
        F.when(~same("model_id", F.lit(model)), F.concat(F.lit("model_mismatch:"), F.coalesce("model_id", F.lit("")))),
        F.when(~same("ui_model_id", F.lit(model)), "ui_model_mismatch"),
        F.when(~same("ui_model_id", F.col("model_id")), "ui_model_differs"),
        F.when(~same("digest", F.lit(digest)), "digest_mismatch"),
        F.when(wrong_size, "size_mismatch"),
        *[F.when(F.col(c).isNull(), f"missing_sampling:{c}") for c in sampling],
    ]
    return F.array_join(F.array_compact(F.array(*found)), ",")


def manifest_problems(manifest: dict, required: Iterable[str], seed: int, source: str) -> list[str]:
    """Fields that a data manifest lacks, and a seed or source that isn't the configured one."""
    out = [f"missing: {f}" for f in required if f not in manifest]
    if manifest.get("seed") != seed:
        out.append(f"seed: {manifest.get('seed')!r}")
    if (manifest.get("source") or {}).get("dataset") != source:
        out.append("source")
    return out


def shard_problems(manifest: dict) -> list[str]:
    """What is wrong with a manifest of 16-bit shards: sizes, sums, hashes, order."""
    out, total = [], 0
    for k, s in enumerate(manifest.get("shards") or []):
        total += s["tokens"]
        checks = {"bytes": s["bytes"] == 2 * s["tokens"], "sha256": re.fullmatch("[0-9a-f]{64}", s["sha256"]) is not None, "tokens": s["tokens"] > 0, "order": f"{k:06d}" in s["name"]}
        out += [f"{s['name']}: {n}" for n, good in checks.items() if not good]
    if total != manifest.get("total_tokens", total):
        out.append(f"total_tokens: {total}")
    return out


def path_problems(path: str, under: Sequence[str], forbidden: Sequence[str] = ()) -> list[str]:
    """forbidden words that a path holds anywhere, and parts that it must hold in a row but doesn't."""
    plain = path.replace("\\", "/").lower()
    parts = [p for p in plain.split("/") if p]
    inside = any(parts[k : k + len(under)] == list(under) for k in range(len(parts) - len(under) + 1))
    return [f"holds {w}" for w in forbidden if w in plain] + ([] if inside else [f"not under {'/'.join(under)}"])


def special_token_problems(pieces: dict[str, int], kinds: dict[int, str], expected: dict[str, tuple[int, str]], chat: Sequence[str], listed: Sequence[str], unknown: int) -> list[str]:
    """What is wrong with a vocabulary's special tokens.

    pieces: ids by piece; kinds: unknown, control or byte by id; expected: id and kind of each base token;
    chat: tokens in the order in which `listed` must hold them.
    """
    out = [f"{p}: id {pieces.get(p)!r}" for p, (i, _) in expected.items() if pieces.get(p) != i]
    out += [f"{p}: not {kind}" for p, (i, kind) in expected.items() if kinds.get(i) != kind]
    out += [f"{p}: missing" for p in chat if pieces.get(p, unknown) == unknown]
    if list(chat) != list(listed):
        out.append("order of chat tokens")
    if "byte" in kinds.values():
        out.append("byte pieces")
    return out


def status_problems(status: dict, version: int = 1) -> list[str]:
    """What is wrong with a run's status record."""
    checks = {"schema_version": status.get("schema_version") == version, "state": status.get("state") in STATES, "run_id": bool(str(status.get("run_id") or "").strip())}
    checks |= {n: int(status.get(n, -1)) >= 0 for n in ("step", "processed_tokens")}
    return [n for n, good in checks.items() if not good]


def provenance_problems(entry: dict, required: Iterable[str], enums: dict[str, Sequence[str]]) -> list[str]:
    """Fields that a record lacks, and values outside their enumerations."""
    return [f"missing: {f}" for f in required if f not in entry] + [f"invalid {f}: {entry[f]!r}" for f, known in enums.items() if entry.get(f) is not None and entry[f] not in known]


def now() -> str:
    """The time in UTC as ISO text."""
    return datetime.now(timezone.utc).isoformat()
