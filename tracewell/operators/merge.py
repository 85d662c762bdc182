"""Order-dependent merging of candidates into stored instincts, memories and procedures.

Each candidate sees what the ones before it left behind, so merging is a fold. It is split where that
cannot matter: rows that share no gate and no id, directly or through others, form separate components,
and each component is folded as a stream in order of ``seq``. Input columns are those of
``schemas``; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import SLUG_CHARACTERS, kebab_id, normal_keywords
from ..runtime import big_join
from .components import components

_NOT_SLUG, _KEBAB = re.compile(f"[^{SLUG_CHARACTERS}]+"), re.compile(r"[a-z0-9]+(-[a-z0-9]+)*\Z")


def next_confidence(current: float, hit: bool) -> float:
    return min(current + S.HIT_STEP, S.CONFIDENCE_CAP) if hit else current - S.MISS_STEP


def slug_of(text: str) -> str:
    text = text.strip()
    return (_NOT_SLUG.sub("-", text).strip("-").lower() or md5(text.encode()).hexdigest()[:8])[: S.ID_CUT]


def id_of(candidate: str | None, fallback: str) -> str:
    candidate = (candidate or "").strip()
    return candidate[: S.ID_CUT] if _KEBAB.match(candidate) else slug_of(fallback)


class _Store:
    """Rows by id in candidate order: a touched row moves to the end; the first of equal scores wins.

    Character sets are bit masks, and rows are indexed by their gates, so a candidate is compared only with
    the rows it may merge with.
    """

    def __init__(self, rows: list[dict], text: str, gates: Callable[[dict], Iterable[str]]):
        self.text, self.gates, self.rows = text, gates, {}
        self.bits: dict[str, int] = {}
        self.mask: dict[str, int] = {}
        self.place: dict[str, int] = {}
        self.members: dict[str, set[str]] = {}
        self.count = 0
        for r in sorted(rows, key=lambda r: f"{r['id']}.md"):
            self.put(r)

    def _mask(self, text: str | None) -> int:
        out = 0
        for c in set((text or "").replace(" ", "")):
            out |= 1 << self.bits.setdefault(c, len(self.bits))
        return out

    def put(self, row: dict) -> None:
        key, old = row["id"], self.rows.get(row["id"])
        for g in self.gates(old) if old else ():
            self.members[g].discard(key)
        self.rows[key], self.mask[key], self.place[key] = row, self._mask(row[self.text]), self.count
        self.count += 1
        for g in self.gates(row):
            self.members.setdefault(g, set()).add(key)

    def best(self, text: str, gates: Iterable[str]) -> dict | None:
        mine, best, score = self._mask(text), None, 0.0
        for key in set().union(*(self.members.get(g, ()) for g in gates)):
            both, all_ = (mine & self.mask[key]).bit_count(), (mine | self.mask[key]).bit_count()
            s = both / all_ if both else 0.0
            if s >= S.SIMILAR_FROM and (s > score or (s == score and self.place[key] < self.place[best])):
                best, score = key, s
        return self.rows[best] if best is not None else None

    def in_order(self) -> list[dict]:
        return [self.rows[k] for k in sorted(self.rows, key=self.place.__getitem__)]


def fold_instincts(stored: list[dict], candidates: Iterable[dict], today: dt.date) -> list[dict]:
    """Merge by similar trigger within a domain, else by id; new rows begin at the initial confidence."""
    gate = lambda r: [d] if (d := (r["domain"] or "").strip()) else []
    store = _Store(stored, "trigger", gate)
    for c in candidates:
        trigger = (c["trigger"] or "").strip()
        if not trigger:
            continue
        domain = (c["domain"] or "").strip()
        row = store.best(trigger, gate(c))
        row = row or store.rows.get(id_of(c["id"], trigger))
        body = f"## Action\n{c['action']}\n\n## Evidence\n{c['evidence'] or ''}" if c["action"] else trigger
        if row is None:
            new = {"id": id_of(c["id"], trigger), "confidence": S.INITIAL_CONFIDENCE, "hit_count": 1, "scope": "project"}
        else:
            new = {**row, "confidence": next_confidence(row["confidence"] if row["confidence"] is not None else S.INITIAL_CONFIDENCE, True), "hit_count": int(row["hit_count"] or 0) + 1}
        store.put({**new, "trigger": trigger, "domain": domain or (row or {}).get("domain") or "", "deprecated": False, "last_seen": today, "body": body})
    return store.in_order()


def fold_facts(stored: list[dict], candidates: Iterable[dict], today: dt.date) -> list[dict]:
    """Merge by similar description among rows that share a keyword, else by id; a merge replaces the row."""
    gates = lambda r: {k.strip().lower() for k in r["keywords"] or [] if k and k.strip()}
    store = _Store(stored, "description", gates)
    for c in candidates:
        description = (c["description"] or "").strip()
        if not description:
            continue
        row = store.best(description, gates(c))
        key = row["id"] if row else id_of(c["name"], description)
        store.put({"id": key, "type": c["type"] or "project", "keywords": c["keywords"] or [], "description": description, "created": today, "body": c["body"] or description})
    return store.in_order()


def fold_procedures(stored: list[dict], candidates: Iterable[dict], today: dt.date) -> list[dict]:
    """Merge by similar task; success moves confidence; enough of it promotes, once, and nothing demotes."""
    store = _Store(stored, "task_type", lambda _: ("all",))
    for c in candidates:
        task = (c["task_type"] or "").strip()
        if not task:
            continue
        row = store.best(task, ("all",))
        old = row or {}
        prior = old.get("confidence")
        confidence = next_confidence(S.INITIAL_CONFIDENCE if prior is None else prior, bool(c["is_successful"]))
        revived = old.get("status") == "deprecated"
        status = "candidate" if row is None or revived else (old.get("status") or "candidate")
        promoted_now = status != "promoted" and confidence >= S.PROMOTE_AT
        sessions = list(old.get("evidence_sessions") or [])
        if c["session_id"] and c["session_id"] not in sessions:
            sessions.append(c["session_id"])
        steps = "\n".join(f"{i}. {s}" for i, s in enumerate(c["steps"] or [], 1))
        store.put({"id": old.get("id") or id_of(c["id"], task), "task_type": task, "hit_count": int(old.get("hit_count") or 0) + 1, "confidence": confidence, "status": "promoted" if promoted_now else status, "skill_asked": False if revived or row is None else bool(old.get("skill_asked")), "first_seen": old.get("first_seen") or today, "last_seen": today, "evidence_sessions": sessions, "body": steps + (f"\n\n{c['note']}" if c["note"] else ""), "promoted_now": promoted_now or bool(old.get("promoted_now"))})
    return store.in_order()


def _folded(store: DataFrame, candidates: DataFrame, links: DataFrame, fold, schema, today: dt.date) -> DataFrame:  # noqa: ANN001
    """Run a fold for every component. ``links`` has (side, row, key): the keys that store rows ('s', id) and candidates ('c', seq) have.

    Rows are spread by component and sorted, stored ones first; a task folds its components one after the other
    as a stream. It holds the entities of one component - what is stored and what the candidates made of it - but
    no candidates, however many there are.
    """
    labelled = components(links.select(F.concat("side", "row").alias("node"), "key"))
    s = big_join(store.select(F.concat(F.lit("s"), F.col("id")).alias("node"), F.to_json(F.struct(*schema.fieldNames())).alias("json"), F.lit(-1).cast("long").alias("seq")), labelled, "node")
    c = big_join(candidates.select(F.concat(F.lit("c"), F.col("seq").cast("string")).alias("node"), F.to_json(F.struct("*")).alias("json"), F.col("seq").cast("long").alias("seq")), labelled, "node")
    candidate_fields, store_fields = candidates.columns, schema.fieldNames()
    dates = [f.name for f in schema.fields if f.dataType.typeName() == "date"]

    def stored_row(text: str) -> dict:
        row = json.loads(text)
        row = {k: row.get(k) for k in store_fields}
        return {**row, **{d: dt.date.fromisoformat(row[d]) if row[d] else None for d in dates}}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in frame.itertuples(index=False, name=None))
        for _, group in groupby(rows, key=itemgetter(0)):
            stored, first = [], []
            for _, seq, text in group:
                if seq >= 0:
                    first.append(text)
                    break
                stored.append(stored_row(text))
            new = (json.loads(text) for text in chain(first, (x[2] for x in group)))
            merged = fold(stored, ({k: row.get(k) for k in candidate_fields} for row in new), today)
            for at in range(0, len(merged), 10_000):
                yield pd.DataFrame([{k: r.get(k) for k in store_fields} for r in merged[at : at + 10_000]], columns=store_fields).astype(object)

    ordered = s.unionByName(c).select("component", "seq", "json").repartition("component").sortWithinPartitions("component", "seq", "json")
    return ordered.mapInPandas(run, schema)


def _keys(df: DataFrame, side: str, row: F.Column, keys: list[F.Column]) -> DataFrame:
    own = F.concat(F.lit(f"{side}:"), row.cast("string"))
    return df.select(F.lit(side).alias("side"), row.cast("string").alias("row"), F.explode(F.array_distinct(F.filter(F.array(*keys, own), lambda k: k.isNotNull()))).alias("key"))


def merge_instincts(store: DataFrame, candidates: DataFrame, today: dt.date) -> DataFrame:
    """The stored instincts after all candidates (``schemas.INSTINCT_CANDIDATE``)."""
    domain = lambda c: F.when(F.trim(c) != "", F.concat(F.lit("d:"), F.trim(c)))
    links = _keys(store, "s", F.col("id"), [F.concat(F.lit("i:"), F.col("id")), domain("domain")]).unionByName(_keys(candidates, "c", F.col("seq"), [F.concat(F.lit("i:"), kebab_id("id", "trigger")), domain("domain")]))
    return _folded(store, candidates, links, fold_instincts, S.INSTINCT, today)


def merge_facts(store: DataFrame, candidates: DataFrame, today: dt.date) -> DataFrame:
    """The stored memories after all candidates (``schemas.FACT_CANDIDATE``)."""

    def keys(df: DataFrame, side: str, row: F.Column, key: F.Column) -> DataFrame:
        words = F.transform(normal_keywords("keywords"), lambda k: F.concat(F.lit("k:"), k))
        every = F.concat(F.array(F.concat(F.lit(f"{side}:"), row.cast("string")), F.concat(F.lit("i:"), key)), words)
        return df.select(F.lit(side).alias("side"), row.cast("string").alias("row"), F.explode(F.array_distinct(F.filter(every, lambda k: k.isNotNull()))).alias("key"))

    links = keys(store, "s", F.col("id"), F.col("id")).unionByName(keys(candidates, "c", F.col("seq"), kebab_id("name", "description")))
    return _folded(store, candidates, links, fold_facts, S.MEMORY, today)


def merge_procedures(store: DataFrame, candidates: DataFrame, today: dt.date) -> DataFrame:
    """The stored procedures after all candidates, with ``promoted_now``; one component, as any task may match any."""
    schema = T.StructType([*S.PROCEDURE.fields, T.StructField("promoted_now", T.BooleanType())])
    one = lambda df, side, row: df.select(F.lit(side).alias("side"), row.cast("string").alias("row"), F.lit("all").alias("key"))
    store = store.withColumn("promoted_now", F.lit(False))
    return _folded(store, candidates, one(store, "s", F.col("id")).unionByName(one(candidates, "c", F.col("seq"))), fold_procedures, schema, today)
