"""Corpus roots, freeze markers and packs: inventories bound by hashes, public ids, and checks that nothing is given away."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import files
from ..sources.registry import canonical, fingerprint
from .corpus import hmac_id

MANIFEST, FROZEN, CERTIFICATION = "manifest.json", "FROZEN.json", "certification.json"
#: Keys a public record may not hold at any depth.
FORBIDDEN = ("text", "page_text", "value_text", "label_text", "regions_gold", "document_id", "source_url")


def inventory(folder: str) -> dict[str, dict]:
    """sha256 and size of every file below ``folder``, but for the manifest, the freeze marker and the certification."""
    return files.hashes(folder, (MANIFEST, FROZEN, CERTIFICATION))


def build_root(folder: str, tables: dict[str, DataFrame], documents: dict[str, dict]) -> dict:
    """A corpus root: tables as JSON lines, documents as canonical JSON, a manifest; built beside and renamed into place."""
    if files.exists(folder):
        raise FileExistsError(folder)
    work = folder + ".part"
    files.remove(work)
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{work}/{name}")
    for name, value in documents.items():
        files.write_text(f"{work}/{name}", canonical(value) + "\n")
    held = inventory(work)
    manifest = {"files": held, "fingerprint": fingerprint(held)}
    files.write_text(f"{work}/{MANIFEST}", json.dumps(manifest, sort_keys=True, indent=2))
    files.rename(work, folder)
    return manifest


def verify_root(folder: str) -> list[str]:
    """What does not agree with the manifest (and the freeze marker, if any); empty if all does."""
    manifest = json.loads(files.read_text(f"{folder}/{MANIFEST}"))
    now = inventory(folder)
    problems = [f"missing: {p}" for p in manifest["files"] if p not in now] + [f"added: {p}" for p in now if p not in manifest["files"]]
    problems += [f"changed: {p}" for p, v in now.items() if p in manifest["files"] and manifest["files"][p] != v]
    if manifest["fingerprint"] != fingerprint(manifest["files"]):
        problems.append("fingerprint of the manifest")
    if files.exists(f"{folder}/{FROZEN}") and json.loads(files.read_text(f"{folder}/{FROZEN}")).get("fingerprint") != manifest["fingerprint"]:
        problems.append("freeze marker")
    return problems


def freeze(folder: str) -> str:
    """Writes the freeze marker after verifying; a root that does not verify is not frozen."""
    if problems := verify_root(folder):
        raise ValueError("; ".join(problems))
    mark = json.loads(files.read_text(f"{folder}/{MANIFEST}"))["fingerprint"]
    files.write_text(f"{folder}/{FROZEN}", json.dumps({"fingerprint": mark}))
    return mark


def statistics(gold: DataFrame) -> dict[str, int]:
    """Pages, documents, regions, lines and characters of gold pages."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    lines = F.flatten(F.transform("regions", lambda r: F.coalesce(r["lines"], F.array())))
    chars = F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.length(x["text"]), F.lit(0)))
    return gold.agg(F.count("*").alias("pages"), F.count_distinct("document_id").alias("documents"), n(F.size("regions")).alias("regions"), n(F.size(lines)).alias("lines"), n(chars).alias("characters")).first().asDict()


def build_release(folder: str, gold: DataFrame, registry: list[dict], version: str) -> dict:
    """A corpus root of gold pages with statistics, the registry of its sources, its version and the fingerprint of its pages; frozen."""
    build_root(folder, {"gold": gold}, {"stats.json": statistics(gold), "sources.json": {"sources": registry}, "version.json": {"version": version}})
    freeze(folder)
    return json.loads(files.read_text(f"{folder}/{MANIFEST}"))


def certify(folder: str, schema, registry: list[dict], accepted: set[str], version: str) -> dict[str, bool]:
    """Twelve checks of a frozen release, each by itself, written to its certification file with ``certified`` if all hold.

    ``schema`` is that of the gold pages, ``registry`` the sources (source_id, license_expression) it must have been built from, ``accepted`` the licences allowed.
    """
    from pyspark.sql import SparkSession

    from .corpus import split_leaks
    from .suite import page_issues

    def read(name: str):
        return json.loads(files.read_text(f"{folder}/{name}")) if files.exists(f"{folder}/{name}") else {}

    manifest, held = read(MANIFEST), inventory(folder)
    listed = manifest.get("files", {})
    gold = SparkSession.active().read.schema(schema).json(f"{folder}/gold")
    licences = {r["source_id"]: r["license_expression"] for r in registry}
    used = [r[0] for r in gold.select(F.col("metadata.source_collection")).distinct().limit(len(licences) + 1).collect()]
    errors = page_issues(gold).where("severity = 'error'").limit(1).count()
    leaks = split_leaks(gold, "split", ["document_id"]).limit(1).count()
    checks = {
        "manifest_schema": isinstance(listed, dict) and all(isinstance(v.get("bytes"), int) and re.fullmatch("[0-9a-f]{64}", v.get("sha256", "")) for v in listed.values()) and bool(re.fullmatch("[0-9a-f]{64}", manifest.get("fingerprint", ""))),
        "required_files": {"stats.json", "sources.json", "version.json"} <= listed.keys() and any(k.startswith("gold/") for k in listed),
        "benchmark_version": read("version.json").get("version") == version,
        "registry_fingerprint": fingerprint(read("sources.json").get("sources", [])) == fingerprint(registry),
        "dataset_fingerprint": manifest.get("fingerprint") == fingerprint(listed),
        "freeze_marker": bool(manifest) and read(FROZEN).get("fingerprint") == manifest.get("fingerprint"),
        "manifest_inventory": listed == held,
        "source_provenance": all(u in licences for u in used),
        "license_profile": all(licences.get(u) in accepted for u in used),
        "gold_validation": errors == 0,
        "leakage_audit": leaks == 0,
        "statistics_recomputed": read("stats.json") == statistics(gold),
    }
    files.write_text(f"{folder}/{CERTIFICATION}", json.dumps({"checks": checks, "certified": all(checks.values())}, sort_keys=True, indent=2))
    return checks


def participant_pack(pages: DataFrame, key: str) -> DataFrame:
    """What participants get: public ids of page and lines, image path, boxes; never text or original ids."""
    public = hmac_id(key, "page", F.col("page_id"))
    regions = F.transform("regions", lambda r: F.struct(hmac_id(key, "region", F.concat("page_id", F.lit("/"), r["region_id"])).alias("region_id"), r["polygon"].alias("polygon"), F.transform(r["lines"], lambda x: F.struct(hmac_id(key, "line", F.concat("page_id", F.lit("/"), x["line_id"])).alias("line_id"), x["polygon"].alias("polygon"))).alias("lines")))
    return pages.select(public.alias("public_id"), F.concat(F.lit("images/"), F.substring(F.sha2(public, 256), 1, 2), F.lit("/"), public, F.lit(".png")).alias("image"), regions.alias("layout"))


def id_map(pages: DataFrame, key: str) -> DataFrame:
    return pages.select(hmac_id(key, "page", F.col("page_id")).alias("public_id"), "page_id")


def map_back(submission: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with page_id, problems): ids that are unknown, missing or given twice."""
    n = submission.groupBy("public_id").agg(F.count("*").alias("n"))
    j = ids.join(n, "public_id", "full")
    problem = F.when(F.col("page_id").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return submission.join(ids, "public_id"), j.withColumn("problem", problem).where("problem is not null").select("public_id", "problem")


def aliases_wrong(ids: DataFrame, key: str) -> DataFrame:
    """Rows of an id map whose public id is not the one the key gives."""
    return ids.where(F.col("public_id") != hmac_id(key, "page", F.col("page_id")))


def given_away(df: DataFrame) -> DataFrame:
    """(row, problem) of public records that hold a forbidden key or an absolute or local path at any depth."""
    keys = "|".join(map(re.escape, FORBIDDEN))
    j = F.to_json(F.struct(*df.columns))
    problem = F.when(j.rlike(f'"({keys})"\\s*:'), "forbidden_key").when(j.rlike(r'"(/|file:|[A-Za-z]:\\\\|~/)'), "local_path")
    return df.select(j.alias("row"), problem.alias("problem")).where("problem is not null")
