"""One question, or a table of them, through policy, aggregates, lookups, wording and audit."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import field_map, ungrounded
from ..functions.prompts import prompt
from ..functions.questions import parse
from ..operators import index
from ..operators.aggregates import answer_aggregates, sentence, sentences
from ..operators.audit import AuditLog
from ..operators.policy import apply_policy, denied
from ..operators.search import encode, hamming_top_k
from ..operators.verified import TEMPLATE, answer_verified, mentioned
from ..sources.records import AccessPolicy, number_rows
from ..storage import stash

DENIAL = "The access policy does not permit this answer."


@dataclass
class Settings:
    k: int = 5
    min_score: float = 0.52
    template: str = TEMPLATE
    #: "styled": wording by a generator, figures by code; "generative": a generator reads the records, and figures it invents block its answer.
    mode: str = "verified"
    history: int = 6


@dataclass
class Answer:
    text: str
    path: str
    sources: list[str] = field(default_factory=list)
    hashes: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    refused: bool = False
    ambiguous: bool = False
    policy: str = "unrestricted"
    policy_denied: bool = False
    blocked_generation: str | None = None
    retrieval_ms: float = 0.0
    generation_ms: float = 0.0
    total_ms: float = 0.0


class Engine:
    """Answers over entries (``id, text``; ``pos``, ``fields`` and ``hv`` are added where missing).

    ``open`` takes a saved index, whose vectors are read and not made again.
    Entries and their vocabulary are kept in the executors' memory (what does
    not fit goes to disk) after the first question; ``close`` lets them go.
    """

    def __init__(self, entries: DataFrame, settings: Settings | None = None, audit: AuditLog | None = None, generator: Callable[[str], str] | None = None):
        self.spark: SparkSession = entries.sparkSession
        self._keep(entries)
        self.stored: tuple[str, int] = ("", 0)  # where the entries come from, and the version
        self.settings, self.audit, self.generator = settings or Settings(), audit, generator

    def _keep(self, entries: DataFrame) -> None:
        self.entries = prepared(entries).persist(StorageLevel.MEMORY_AND_DISK)
        self.vocabulary = index.known_entities(self.entries).persist(StorageLevel.MEMORY_AND_DISK)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **given) -> Engine:
        version = index.current(spark, path)
        engine = cls(index.load(spark, path, number=version.number), **given)
        engine.stored = (path, version.number)
        return engine

    def save(self, path: str, **how) -> None:
        """Write all entries; back to where they came from only if no other writer has changed that meanwhile. ``how``: as for ``index.save``."""
        came_from, number = self.stored
        version = index.save(self.entries, path, expected=number if path == came_from else None, **how)
        self.stored = (path, version.number)

    def add(self, entries: DataFrame) -> None:
        """Upsert ``entries (id, text)`` into the stored index this engine was opened from or saved to; only they are encoded."""
        path, _ = self.stored
        if not path:
            raise ValueError("save the engine first")
        if "pos" not in entries.columns:
            entries = number_rows(entries.withColumn("__at", F.monotonically_increasing_id()), "__at").withColumnRenamed("n", "pos")
        version = index.append(entries, path)
        self.close()
        self._keep(index.load(self.spark, path, number=version.number))
        self.stored = (path, version.number)

    def close(self) -> None:
        self.vocabulary.unpersist()
        self.entries.unpersist()

    def scope(self, policy: AccessPolicy) -> DataFrame:
        return apply_policy(self.entries, policy)

    def names_in(self, scope: DataFrame, policy: AccessPolicy) -> DataFrame:
        """The vocabulary of what a policy shows."""
        return self.vocabulary if policy.is_unrestricted else index.known_entities(scope)

    def retrieve(self, questions: DataFrame, scope: DataFrame) -> DataFrame:
        """``query_id, rank, id, text, score`` from the permitted entries only."""
        asked = encode(questions.select("query_id", "question"), "question")
        hits = hamming_top_k(scope, asked, self.settings.k)
        return hits.join(scope.select("pos", "text"), "pos").select("query_id", "rank", "id", "text", "score")

    def answer_batch(self, questions: DataFrame, policy: AccessPolicy | None = None) -> DataFrame:
        """``query_id, text, path, sources, hashes, values, refused, ambiguous`` for ``query_id, question``."""
        policy = policy or AccessPolicy()
        scope = self.scope(policy)
        parsed = parse(questions).withColumn("__denied", denied(policy))
        no = F.array().cast("array<string>")
        plain = lambda df, text, path, values, refused: df.select("query_id", text.alias("text"), F.lit(path).alias("path"), no.alias("sources"), no.alias("hashes"), values.alias("values"), F.lit(refused).alias("refused"), F.lit(False).alias("ambiguous"))
        refused = plain(parsed.where("__denied"), F.lit(DENIAL), "policy_denial", no, True)
        allowed = parsed.where("not __denied").select("query_id", "question")
        told = stash(sentences(answer_aggregates(scope, allowed.select("question").distinct())))  # read twice
        by_code = plain(allowed.join(told, "question"), F.col("text"), "computed", F.array_compact(F.array("value")), False)
        rest = allowed.join(told, "question", "left_anti")
        looked = answer_verified(rest, self.retrieve(rest, scope), scope, self.names_in(scope, policy), self.settings.min_score, self.settings.template)
        return refused.unionByName(by_code).unionByName(looked.select(*refused.columns))

    def _look_up(self, asked: DataFrame, policy: AccessPolicy) -> tuple:
        """The verified answer of one question and its hits; each scan's few rows come to the driver, so that later steps are local."""
        scope = self.scope(policy)
        found = encode(asked, "question").collect()
        hits = hamming_top_k(scope, self.spark.createDataFrame(found, "query_id long, question string, hv binary"), self.settings.k).orderBy("rank").collect()
        near = [h.pos for h in hits]
        texts = {r.pos: r.text for r in scope.where(F.col("pos").isin(near)).select("pos", "text").collect()} if near else {}
        rows = [(0, h["rank"], h.id, texts[h.pos], h.score) for h in hits]
        hits = self.spark.createDataFrame(rows, "query_id long, rank int, id string, text string, score double")
        names = self.spark.createDataFrame(mentioned(asked, self.names_in(scope, policy)).collect(), "query_id long, name string")
        r = answer_verified(asked, hits, scope, None, self.settings.min_score, self.settings.template, names).first()
        return r, rows

    def query(self, question: str, policy: AccessPolicy | None = None, principal: str = "", history: list[dict] | None = None) -> Answer:
        """One question; a generator's words are kept only if they bring no figure of their own."""
        began = time.perf_counter()
        policy = policy or AccessPolicy()
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        read = parse(asked).withColumn("__denied", denied(policy)).first()
        hits: list = []
        if read["__denied"]:
            out = Answer(DENIAL, "policy_denial", refused=True, policy_denied=True)
        else:
            told = answer_aggregates(self.scope(policy), asked.select("question")).first() if read.operation else None
            if told:
                out = Answer(sentence(told), "computed", values=[told.value] if told.value is not None else [])
            else:
                r, hits = self._look_up(asked, policy)
                out = Answer(r.text, r.path, list(r.sources), list(r.hashes), list(r["values"]), r.refused, r.ambiguous)
        out.policy = policy.name
        found = time.perf_counter()
        out.retrieval_ms = 1000 * (found - began)
        if self.generator and self.settings.mode == "styled" and not out.refused:
            draft = self.generator(self.prompt(question, out.text, history))
            if self._invents(draft, out.text, question):
                out.blocked_generation = draft
            else:
                out.text = draft
            out.generation_ms = 1000 * (time.perf_counter() - found)
        elif self.generator and self.settings.mode == "generative" and hits:
            facts = "\n\n".join(text for _, _, _, text, _ in hits)
            draft = self.generator(self.prompt(question, facts, history))
            if self._invents(draft, facts, question):
                out.blocked_generation = draft  # the verified answer stands
            else:
                out.text, out.path, out.values, out.refused, out.ambiguous = draft, "generative", [], False, False
                out.sources = [i for _, _, i, _, _ in hits]
                out.hashes = [hashlib.sha256(text.encode()).hexdigest() for _, _, _, text, _ in hits]
            out.generation_ms = 1000 * (time.perf_counter() - found)
        out.total_ms = 1000 * (time.perf_counter() - began)
        if self.audit:
            cited = sorted(zip(out.sources, out.hashes))
            self.audit.record(
                {
                    "principal": principal, "policy": policy.name, "question": question, "answer_path": out.path, "refused": int(out.refused),
                    "policy_denied": int(out.policy_denied), "blocked_generation": int(out.blocked_generation is not None), "record_ids": [i for i, _ in cited],
                    "record_hashes": [h for _, h in cited], "answer_sha256": hashlib.sha256(out.text.encode()).hexdigest(),
                    "retrieval_ms": out.retrieval_ms, "generation_ms": out.generation_ms,
                }
            )
        return out

    def _invents(self, draft: str, facts: str, question: str) -> bool:
        row = self.spark.createDataFrame([(draft, facts, question)], "a string, s string, q string")
        return bool(row.select(ungrounded(F.col("a"), F.col("s"), F.col("q")).alias("u")).first().u)

    def prompt(self, question: str, facts: str, history: list[dict] | None = None) -> str:
        """Facts are marked as data, the last turns follow, the question closes."""
        return prompt(question, facts, "\n".join(f"{m['role']}: {m['content']}" for m in (history or [])[-self.settings.history :]))

    def chat(self, messages: list[dict], policy: AccessPolicy | None = None) -> Answer:
        """The last user message is the question, earlier ones its history."""
        last = max(i for i, m in enumerate(messages) if m["role"] == "user")
        return self.query(messages[last]["content"], policy, history=messages[:last])


def prepared(entries: DataFrame) -> DataFrame:
    """Entries with their place, field map and vector, each made only where it is missing."""
    if "pos" not in entries.columns:
        entries = number_rows(entries.withColumn("__at", F.monotonically_increasing_id()), "__at").withColumnRenamed("n", "pos")
    if "fields" not in entries.columns:
        entries = entries.withColumn("fields", field_map("text"))
    return entries if "hv" in entries.columns else encode(entries)
