"""Refresh, search and audit over a versioned index of Parquet tables.

A refresh writes sources, chunks, postings, statistics, the vector cache and rejections as a new version and then moves the pointer, so
readers see the old version or the new one.  Only files that the listing shows as new or changed are read and tokenized, and only
texts that the cache does not hold are embedded.  A search reads stored postings and vectors, and texts of its hits alone.

The pointer and the lock are plain files: the index lies on a disk or mount that the driver and all executors share.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .embedders import EmbeddingUnavailable, made_by, one_vector
from .functions.text import folded, private_query_reason, sha256
from .operators import chunking, gates, index, ranking, refresh, selection, snippets, trust
from .sources.files import disk_state, list_files, missing_roots

#: Raised when the rules for chunks change, so that stored chunks are made anew.
PARSE_VERSION = "1"
#: Raised when the rules for tokens change, so that stored postings are made anew from stored chunks.
TOKEN_VERSION = "1"
_POSTINGS = "path string, ordinal int, term string, tf long, dl long"
_VECTORS = "text_hash string, model string, embedding array<double>, last_used double"
_SOURCE_COLUMNS = ["path", "content_hash", "file_type", "mtime", "byte_count", "project", "root_label", "permissions", "indexed_at"]


class PrivateQuery(RuntimeError):
    """A question asks for credential-shaped material."""


class NoIndex(RuntimeError):
    """There is no index yet."""


class Engine:
    def __init__(self, spark: SparkSession, config: dict, embedder=None):
        self.spark, self.config = spark, C.validate(config)
        self.home = Path(config["index_path"])
        self.embedder = embedder or made_by(config["embedding"])

    # storage -----------------------------------------------------------------------------------

    def metadata(self) -> dict:
        try:
            return json.loads((self.home / "current.json").read_text())
        except FileNotFoundError as e:
            raise NoIndex(f"no index at {self.home}; refresh first") from e

    def read(self, name: str) -> DataFrame:
        return self.read_version(self.metadata()["version"], name)

    def read_version(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.home / version / name))

    # ingest ------------------------------------------------------------------------------------

    def listing(self) -> tuple[DataFrame, DataFrame]:
        """(selected files, rejections) of all roots."""
        c, ex = self.config, self.config["exclusions"]
        own = str(self.home.resolve())
        chosen, rejected = [], None
        for r in c["corpus_roots"]:
            if not os.path.exists(r["path"]):
                continue
            files = list_files(self.spark, [r["path"]], [r.get("label") or Path(r["path"]).name], r.get("max_depth", 0), ex.get("denied_path_parts", []))
            walked = files.where(F.col("reason").isNotNull() & F.col("reason").startswith("denied"))
            files = files.where(F.col("reason").isNull() | ~F.col("reason").startswith("denied")).withColumnRenamed("reason", "found")
            gated = gates.gate(files, c["allowed_extensions"], ex.get("denied_path_parts", []), ex.get("denied_name_fragments", []), ex.get("denied_globs", []), c.get("max_file_bytes", 262_144), own)
            gated = gated.withColumn("reason", F.coalesce("found", "reason")).drop("found").cache()
            usable = gated.where("reason is null")
            if r.get("selection", "newest") == "balanced":
                picked = selection.balanced(usable, r.get("max_files", 0), r.get("max_files_per_project", 200))
            else:
                picked = selection.newest(usable, r.get("max_files", 0))
            chosen.append(picked)
            bad = walked.select("path", "reason").unionByName(gated.where("reason is not null").select("path", "reason")).unionByName(picked.where("not selected").select("path", F.lit("over the selection budget").alias("reason")))
            rejected = bad if rejected is None else rejected.unionByName(bad)
        if not chosen:
            raise RuntimeError("no corpus root exists")
        return selection.first_owner(chosen), rejected.distinct()

    def refresh(self, full: bool = False, now: float | None = None) -> dict:
        """One pass: list, compare, read what changed, chunk, embed, write the next version.  Returns counters."""
        now = time.time() if now is None else now
        self.home.mkdir(parents=True, exist_ok=True)
        with open(self.home / ".lock", "w") as lock:
            try:
                fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise RuntimeError("another refresh is running") from e
            return self._refresh(full, now)

    def _refresh(self, full: bool, now: float) -> dict:
        c, model = self.config, self.embedder.model
        geometry = {"chunk_chars": c["chunk_chars"], "overlap": c["chunk_overlap_chars"], "parse_version": c["parse_version"] + "/" + PARSE_VERSION, "chunker": c.get("chunker", "")}
        empty_sources = self.spark.createDataFrame([], "path string, content_hash string, file_type string, mtime double, byte_count long, project string, root_label string, permissions string, indexed_at double")
        cache = self.spark.createDataFrame([], _VECTORS)
        try:
            meta = self.metadata()
            known, old, cache = self.read("sources"), self.read("chunks"), self.read("vectors")
            if meta["model"] != model and not full:
                raise RuntimeError("the index has another embedding model; refresh with full")
            if meta["dimensions"] and meta["dimensions"] != self.embedder.dimensions and not full:
                raise RuntimeError(f"the model gives {self.embedder.dimensions} dimensions and the index has {meta['dimensions']}; refresh with full")
            rechunk = full or meta["geometry"] != geometry
            retoken = rechunk or meta["tokens"] != TOKEN_VERSION
            version = f"v{int(meta['version'][1:]) + 1}"
        except NoIndex:
            known, old, rechunk, retoken, version = empty_sources, None, False, False, "v1"
        listed, rejected = self.listing()
        listed = listed.select("path", "project", "root_label", "file_type", "mtime", F.col("size").alias("byte_count")).cache()
        same = known.select("path", F.col("byte_count").alias("kb"), F.col("mtime").alias("km"), F.col("content_hash").alias("kh"))
        checked = listed.join(same, "path", "left").withColumn("same", F.coalesce((F.col("kb") == F.col("byte_count")) & (F.abs(F.col("km") - F.col("mtime")) < 1e-6), F.lit(False)) & F.lit(not rechunk))
        # only files whose listing differs are read
        read = self._contents(checked.where("not same").select("path")).cache()
        refused = read.where("reason is not null").select("path", "reason")
        texts = read.where("reason is null").select("path", F.col("content").cast("string").alias("text"), sha256(F.col("content")).alias("new_hash"))
        seen = checked.join(texts, "path", "left").where("same or new_hash is not null").withColumn("content_hash", F.when(F.col("same"), F.col("kh")).otherwise(F.col("new_hash")))
        seen = seen.select("path", "content_hash", "file_type", "mtime", "byte_count", "project", "root_label", "text").cache()
        gone = missing_roots([r["path"] for r in c["corpus_roots"]])
        labels = [r.get("label") or Path(r["path"]).name for r in c["corpus_roots"] if r["path"] in gone]
        changes = refresh.diff(known, seen, gone, labels, rechunk).cache()
        target = self.home / version
        shutil.rmtree(target, ignore_errors=True)
        fresh_files = seen.join(changes.where(F.col("status").isin("added", "reindexed")), "path", "left_semi")
        fresh = chunking.chunks(fresh_files, c["chunk_chars"], c["chunk_overlap_chars"], c.get("chunker", "")).select("path", "ordinal", "text", "text_hash", "chunk_id").cache()
        chunks = fresh if old is None else refresh.next_chunks(old, fresh, changes)
        chunks = self._written(chunks, target, "chunks")
        posting = index.postings(chunks) if old is None or retoken else refresh.next_postings(self.read("postings"), index.postings(fresh), changes)
        posting = self._written(posting.repartitionByRange("term").sortWithinPartitions("term", "path", "ordinal"), target, "postings")
        tokens = posting.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
        stats = chunks.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(tokens)
        self._written(stats.select("n_chunks", F.when(F.col("n_chunks") > 0, F.col("tokens") / F.col("n_chunks")).otherwise(1.0).alias("avgdl")), target, "statistics")
        embedded = self._next_vectors(cache, fresh, chunks, now, target)
        # a file is as new as its last indexing or touch
        status = changes.select("path", "status")
        stamped = seen.join(status, "path").join(known.select("path", F.col("indexed_at").alias("before")), "path", "left")
        stamped = stamped.withColumn("indexed_at", F.when(F.col("status") == "unchanged", F.col("before")).otherwise(F.lit(now))).withColumn("permissions", F.lit("local_owner_only"))
        written = self._written(refresh.next_sources(known, stamped.select(*_SOURCE_COLUMNS), changes), target, "sources")
        # parts in order, none of which holds all rows
        rejected.unionByName(refused).distinct().repartitionByRange("reason", "path").sortWithinPartitions("reason", "path").write.json(str(target / "rejections"))
        written.repartitionByRange("path").sortWithinPartitions("path").write.json(str(target / "manifest"))
        counts = {r["status"]: r["files"] for r in refresh.counters(changes).collect()}
        dimensions = self.read_version(version, "vectors").select(F.max(F.size("embedding"))).first()[0] or 0
        meta = {"version": version, "model": model, "dimensions": dimensions, "tokens": TOKEN_VERSION, "geometry": geometry, "refreshed_at": now, "digest": refresh.manifest_digest(written).first()[0], "source_count": written.count()}
        for x in (listed, read, seen, changes, fresh):
            x.unpersist()
        for folder in (self.home, target):
            os.chmod(folder, 0o700)
        temporary = self.home / ".current.json.tmp"
        temporary.write_text(json.dumps(meta, sort_keys=True))
        os.chmod(temporary, 0o600)
        os.replace(temporary, self.home / "current.json")
        return counts | {"sources": meta["source_count"], "embedded": embedded, "missing_roots": gone}

    def _next_vectors(self, cache: DataFrame, fresh: DataFrame, chunks: DataFrame, now: float, target: Path) -> int:
        """Write the next vector cache; the number of texts that had to be embedded."""
        model = F.lit(self.embedder.model).alias("model")
        texts = fresh.select("text_hash", "text").dropDuplicates(["text_hash"])
        missing = refresh.missing_vectors(texts, cache, self.embedder.model).cache()
        new = self.embedder.embed(missing).select("text_hash", model, "embedding").cache()
        widths = new.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
        if widths["lo"] is not None and (widths["lo"], widths["hi"]) != (self.embedder.dimensions,) * 2:
            raise RuntimeError(f"embeddings have {widths['lo']} to {widths['hi']} dimensions instead of {self.embedder.dimensions}")
        used = refresh.use_vectors(cache, texts.select("text_hash", model), now)
        kept = refresh.prune_vectors(refresh.store_vectors(used, new, now), now, float(self.config.get("vector_cache_days", 14)), chunks.select("text_hash"))
        self._written(kept, target, "vectors")
        n = missing.count()
        new.unpersist(), missing.unpersist()
        return n

    def _written(self, rows: DataFrame, target: Path, name: str) -> DataFrame:
        rows.write.parquet(str(target / name))
        return self.spark.read.schema(rows.schema).parquet(str(target / name))

    def _contents(self, paths: DataFrame) -> DataFrame:
        """(path, content, reason): reason is set for contents that may not be indexed."""

        def run(batches):
            for pdf in batches:
                data = []
                for p in pdf["path"]:
                    try:
                        with open(p, "rb") as f:
                            data.append(f.read())
                    except OSError:
                        data.append(None)
                yield pdf.assign(content=data)

        got = paths.mapInPandas(run, "path string, content binary")
        return got.withColumn("reason", gates.content_reason(F.col("content")))

    # search ------------------------------------------------------------------------------------

    def search(self, question: str, top_k: int | None = None, project: str | None = None, policy: str | None = None) -> list[dict]:
        """Ranked files with snippet and verdict for one question; a table of questions goes to ranking.rank."""
        return self.answer(question, top_k, project, policy)["results"]

    def answer(self, question: str, top_k: int | None = None, project: str | None = None, policy: str | None = None) -> dict:
        """The question, the policy as applied, warnings, and the results of search()."""
        if not question.strip():
            raise ValueError("an empty question")
        asked = self.spark.createDataFrame([(0, question)], "query_id int, question string")
        reason = asked.select(private_query_reason(F.col("question"))).first()[0]
        if reason:
            raise PrivateQuery(reason)
        meta, warnings = self.metadata(), []
        defaults, chosen = self.config["search_defaults"], C.active_policy(self.config, policy)
        k = ranking.clamp_top_k(top_k, defaults.get("top_k", chosen.top_k), defaults.get("max_top_k", 50))
        chosen = ranking.Policy(**{**chosen.__dict__, "top_k": k})
        allowed = self.read("sources").where(F.col("permissions").isin("local_owner_only"))
        if project and allowed.where(F.contains(folded(F.col("project")), F.lit(project.lower()))).isEmpty():
            warnings.append(f"no indexed project matches '{project}'")
        stored = self.read("chunks")
        chunks = stored.select("path", "ordinal", "text_hash").join(allowed.select("path", "project", "root_label", "mtime", "content_hash", "indexed_at"), "path")
        posting, stats, vectors = self.read("postings"), self.read("statistics"), None
        if chosen.fusion != "keyword":
            try:
                if meta["model"] != self.embedder.model:
                    raise EmbeddingUnavailable(f"the index was made with {meta['model']}")
                asked = one_vector(self.embedder, asked)
                width = asked.select(F.size("vector")).first()[0]
                if meta["dimensions"] and width != meta["dimensions"]:
                    raise EmbeddingUnavailable(f"the model gives {width} dimensions and the index has {meta['dimensions']}")
                held = self.read("vectors").where(F.col("model") == meta["model"]).select("text_hash", F.col("embedding").alias("vector"))
                vectors = chunks.select("path", "ordinal", "text_hash").join(held, "text_hash").select("path", "ordinal", "vector")
            except EmbeddingUnavailable as e:
                warnings.append(f"keywords only: {e}")
                chosen = ranking.Policy(**{**chosen.__dict__, "fusion": "keyword"})
        hits = ranking.rank(asked, chunks, chosen, project, vectors, posting, stats)
        weights = ranking.term_weights(asked, chunks, posting).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
        # no more than top_k rows: the texts of the hits are the only ones that are read
        rows = hits.join(chunks.select("path", "ordinal", "content_hash", "indexed_at", "project"), ["path", "ordinal"]).join(F.broadcast(hits.select("path", "ordinal")).join(stored.select("path", "ordinal", "text"), ["path", "ordinal"]), ["path", "ordinal"])
        rows = rows.join(asked.select("query_id", "question"), "query_id").join(weights, "query_id", "left")
        rows = snippets.snippets(rows, ["query_id", "path", "ordinal"], int(defaults.get("snippet_chars", 240)))
        rows = trust.verdicts(rows, disk_state(self.spark, rows), meta["refreshed_at"])
        results = [r.asDict() for r in rows.select("rank", "score", "path", "project", "ordinal", "snippet", "verdict", "reason", "marker").orderBy("rank").collect()]
        return {"query": question, "policy": chosen.policy_id, "fusion": chosen.fusion, "top_k": k, "project": project, "warnings": warnings, "results": results}

    # audit -------------------------------------------------------------------------------------

    def missing(self) -> list[str]:
        """Roots that do not exist now; their files are not held against the index."""
        return missing_roots([r["path"] for r in self.config["corpus_roots"]])

    def audit(self, deep: bool = True) -> DataFrame:
        """(path, kind) findings; nothing is written.  A shallow audit looks at files without reading them."""
        gone = self.missing()
        labels = [r.get("label") or Path(r["path"]).name for r in self.config["corpus_roots"] if r["path"] in gone]
        known = self.read("sources").where(~F.col("root_label").isin(labels))
        listed, _ = self.listing()
        paths = known.select("path").union(listed.select("path")).distinct()
        state = disk_state(self.spark, paths, deep)
        new = listed.select("path").join(known, "path", "left_anti")
        refused = self._contents(new).where("reason is not null").select("path", F.lit(True).alias("refused"))
        disk = state.join(listed.select("path", F.lit(True).alias("walked")), "path", "left").join(refused, "path", "left").na.fill(False, ["walked", "refused"])
        return trust.drift(known, disk, [r["path"] for r in self.config["corpus_roots"] if r["path"] not in gone], os.getuid(), deep)
