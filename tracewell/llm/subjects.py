"""Subject areas of documents by latent Dirichlet topics (problem 9).

1. Every whole text becomes a bag of words: words broken at line ends are joined, compatibility forms
   unified, digits and marks dropped. The language is the one whose function words are most frequent.
   Copies, texts with equal bags, become one stored bag; the subjects found for it are joined back to all.
2. Document frequencies are counted over the distinct bags of a language; the vocabulary is the words in
   0.2 % to 30 % of them, and the inspected terms however frequent. That bounds it: each bag holds its words
   once, so at most (mean distinct words / 0.002) words can be that frequent, however large the corpus.
3. One topic model a language, fitted by variational EM over the distinct bags: every round is one scan of the
   stored bags that sums topic-term statistics in each partition, adds them up by term in a shuffle, and
   hands the (bounded) totals to the next round.
4. Topics are mapped to subjects by their top terms: a topic belongs to the subject whose inspected terms
   (``INSPECTED``) are most among them. Topics without at least ``least_terms`` are background: general
   vocabulary, adverts, scanning noise.
5. A document has a subject if the topics of that subject explain at least ``least_tokens`` of its tokens
   and ``least_share`` of those explained by any subject: a stray word of another field is not a subject.

The topics start from random weights that favour the inspected terms, so each subject has its topic in every
language from the first round; what the topics become is decided by the documents.

Defined cases: null, empty and blank texts and texts without known words have no subjects; copies do not
change the model, and the subjects of repeated rows are listed once; a null ``doc_id`` is kept as null; no documents give
no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise

#: Frequent function words that only one of the languages has.
FUNCTION_WORDS = {
    "en": "the of and that which his her our from this",
    "de": "der die das und ein eine den dem für mit",
    "fr": "le les des une et ce cette notre dans sous",
    "es": "el los las una y este aquel su nuestro desde",
}
#: Terms found at the top of fitted topics, by subject and language.
INSPECTED = {
    "science": {"en": "telescope microscope experiment physicist chemist comet", "de": "fernrohr mikroskop versuch physiker chemiker komet", "fr": "télescope microscope expérience physicien chimiste comète", "es": "telescopio microscopio experimento físico químico cometa"},
    "law": {"en": "judge jury verdict tribunal defendant barrister", "de": "richter gericht urteil anwalt angeklagter zeuge", "fr": "juge tribunal verdict avocat accusé témoin", "es": "juez tribunal veredicto abogado acusado testigo"},
    "sport": {"en": "goalkeeper referee tournament wicket champion umpire", "de": "torwart schiedsrichter turnier meisterschaft pokal mannschaft", "fr": "arbitre tournoi championnat coupe équipe boxeur", "es": "árbitro torneo campeonato copa equipo boxeador"},
    "software": {"en": "software compiler database keyboard diskette algorithm", "de": "programm prozessor datenbank tastatur diskette algorithmus", "fr": "logiciel processeur ordinateur clavier disquette algorithme", "es": "programa procesador ordenador teclado disquete algoritmo"},
    "farming": {"en": "harvest plough wheat livestock barley manure", "de": "ernte pflug weizen vieh gerste dünger", "fr": "récolte charrue blé bétail orge engrais", "es": "cosecha arado trigo ganado cebada abono"},
    "shipping": {"en": "harbour cargo schooner captain anchor tonnage", "de": "hafen ladung schoner kapitän anker tonnage", "fr": "port cargaison goélette capitaine ancre tonnage", "es": "puerto carga goleta capitán ancla tonelaje"},
    "medicine": {"en": "physician fever vaccine hospital patient surgeon", "de": "arzt fieber impfung krankenhaus patient chirurg", "fr": "médecin fièvre vaccin hôpital malade chirurgien", "es": "médico fiebre vacuna hospital paciente cirujano"},
    "theatre": {"en": "actress opera rehearsal comedy playwright audience", "de": "schauspielerin oper probe komödie bühne publikum", "fr": "actrice opéra répétition comédie dramaturge spectateurs", "es": "actriz ópera ensayo comedia dramaturgo público"},
}
SUBJECTS = tuple(INSPECTED)
_BROKEN = re.compile(r"[-­¬=‐‑■]\s*\n\s*")
_WORD = re.compile(r"[^\W\d_]+")
_LANGUAGES_OF_TERM: dict[str, list[str]] = {}
for _by_language in INSPECTED.values():
    for _language, _terms in _by_language.items():
        for _term in _terms.split():
            _LANGUAGES_OF_TERM.setdefault(_term, []).append(_language)
_LANGUAGE_OF = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words.split()}
#: Copies of one text are joined to its subjects in this many parts.
SALTS = 16
_BAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive x: shifted up by six, then asymptotic."""
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def bag_of_words(text: str | None) -> tuple[str | None, Counter]:
    """(language, words with counts) of a whole text; by function words, else by inspected terms; no language if it has neither."""
    if not text:
        return None, Counter()
    words = Counter(_WORD.findall(unicodedata.normalize("NFKC", _BROKEN.sub("", text.replace("\r\n", "\n"))).lower()))
    votes = Counter()
    for w, lang in _LANGUAGE_OF.items():
        if w in words:
            votes[lang] += words[w]
    if not votes:  # a short text, or a list of names: its inspected terms tell
        for w in words:
            for lang in _LANGUAGES_OF_TERM.get(w, ()):
                votes[lang] += words[w]
    return (max(sorted(votes), key=votes.__getitem__) if votes else None), words


def word_bags(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id_column, key, lang, words, counts); equal bags have equal keys; texts without a language have no row."""
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *_BAG.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                owner, keys, langs, words, counts, offsets = [], [], [], [], [], [0]
                for i, text in enumerate(part.column(1)):
                    lang, bag = bag_of_words(text.as_py())
                    if lang:
                        own = sorted(bag)
                        often = [bag[w] for w in own]
                        owner.append(i)
                        keys.append(hashlib.blake2b(repr((lang, own, often)).encode(), digest_size=16).hexdigest())
                        langs.append(lang)
                        words += own
                        counts += often
                        offsets.append(len(words))
                place = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.ListArray.from_arrays(place, pa.array(words, pa.string())), pa.ListArray.from_arrays(place, pa.array(counts, pa.int32()))], names=schema.fieldNames())

    return df.filter(F.length(text_column) > 0).select(id_column, text_column).mapInArrow(run, schema)


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column, also of a slice."""
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), flat


def vocabulary(bags: DataFrame, low: float, high: float, least: int) -> dict[str, list[str]]:
    """The words of each language whose document frequency lies between the shares; inspected terms also above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = _rows_of(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)[rows] if len(rows) else np.array([], object)
            for lang in sorted(set(langs.tolist())):
                found = pc.value_counts(words.filter(pa.array(langs == lang)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())], names=["lang", "word", "n"])

    sizes = {r["lang"]: r["n"] for r in bags.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bounds = bags.sparkSession.createDataFrame([(lang, max(float(least), low * n), high * n) for lang, n in sizes.items()], "lang string, low double, high double")
    counted = bags.select("lang", "words").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    inspected = F.lit(False)
    for lang in sizes:
        terms = [w for by_lang in INSPECTED.values() for w in by_lang.get(lang, "").split()]
        inspected = inspected | ((F.col("lang") == lang) & F.col("word").isin(terms))
    kept = counted.join(F.broadcast(bounds), "lang").filter((F.col("n") >= F.col("low")) & ((F.col("n") <= F.col("high")) | inspected) & (F.length("word") > 2))
    out: dict[str, list[str]] = {}
    for r in kept.select("lang", "word").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: sorted(words) for lang, words in sorted(out.items())}


def encode_bags(bags: DataFrame, words: dict[str, list[str]], id_column: str) -> DataFrame:
    """(id_column, lang, terms, counts) with term numbers of the language's vocabulary."""
    known = bags.sparkSession.sparkContext.broadcast({lang: pa.array(w, pa.string()) for lang, w in words.items()})
    schema = T.StructType([T.StructField(id_column, bags.schema[id_column].dataType), T.StructField("lang", T.StringType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang, vocabulary_ in known.value.items():
                rows_here = pa.array(np.flatnonzero(langs == lang))
                part = batch.take(rows_here)
                rows, flat = _rows_of(part.column(2))
                terms = pc.index_in(flat, value_set=vocabulary_)
                keep = terms.is_valid()
                sizes = np.bincount(rows[keep.to_numpy(zero_copy_only=False)], minlength=part.num_rows)
                place = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(place, terms.filter(keep).cast(pa.int32())), pa.ListArray.from_arrays(place, part.column(3).flatten().filter(keep))], names=schema.fieldNames())

    return bags.mapInArrow(run, schema).filter(F.size("terms") > 0)


def infer(terms: pa.Array, counts: pa.Array, log_free: np.ndarray, alpha: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each document by topic, term of each entry, tokens of each entry by topic)."""
    rows, flat = _rows_of(terms)
    term = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    count = counts.flatten().to_numpy(zero_copy_only=False).astype(float)
    topics, n = log_free.shape[0], len(terms)
    weight = log_free.T[term]  # entries x topics
    starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    mass = np.ones((n, topics))
    for _ in range(steps):
        gamma = mass + alpha
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(1))[:, None])
        share = theta[rows] * weight
        share *= (count / (share.sum(1) + 1e-100))[:, None]
        mass = np.add.reduceat(share, starts, axis=0)
    return mass, term, share


def fit_topics(encoded: DataFrame, words: dict[str, list[str]], background: int = 4, rounds: int = 6, steps: int = 6, alpha: float = 0.1, eta: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Topic-term weights of each language: one topic for each subject at first, and ``background`` free ones."""
    spark, topics = encoded.sparkSession, len(SUBJECTS) + background
    random, weights = np.random.default_rng(seed), {}
    for lang, vocabulary_ in words.items():
        place = {w: i for i, w in enumerate(vocabulary_)}
        start = random.gamma(100.0, 0.01, (topics, len(vocabulary_)))
        for k, subject in enumerate(SUBJECTS):
            for w in INSPECTED[subject].get(lang, "").split():
                if w in place:
                    start[k, place[w]] *= 20
        weights[lang] = start * 50
    names = [f"t{k}" for k in range(topics)]
    for _ in range(rounds):
        model = spark.sparkContext.broadcast({lang: np.exp(digamma(w) - digamma(w.sum(1))[:, None]) for lang, w in weights.items()})

        def scan(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            totals = {lang: np.zeros(w.shape[::-1]) for lang, w in model.value.items()}
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), object)
                for lang, total in totals.items():
                    part = batch.take(pa.array(np.flatnonzero(langs == lang)))
                    for at in range(0, part.num_rows, 2000):
                        few = part.slice(at, 2000)
                        _, term, share = infer(few.column(1), few.column(2), model.value[lang], alpha, steps)
                        for k in range(topics):
                            total[:, k] += np.bincount(term, share[:, k], minlength=len(total))
            for lang, total in totals.items():
                used = np.flatnonzero(total.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), *[pa.array(total[used, k]) for k in range(topics)]], names=["lang", "term", *names])

        sums = encoded.select("lang", "terms", "counts").mapInArrow(scan, "lang string, term long, " + ", ".join(f"{n} double" for n in names)).groupBy("lang", "term").agg(*[F.sum(n).alias(n) for n in names])
        weights = {lang: np.full(w.shape, eta) for lang, w in weights.items()}
        for r in sums.collect():
            weights[r["lang"]][:, r["term"]] += [r[n] for n in names]
        model.unpersist()
    return weights


def subject_of_topics(weights: np.ndarray, vocabulary_: list[str], lang: str, top: int = 25, least_terms: int = 2) -> list[str | None]:
    """The subject whose inspected terms are most among each topic's top terms, or None."""
    out = []
    for row in weights:
        terms = {vocabulary_[i] for i in np.argsort(-row)[:top]}
        hits = {s: len(terms.intersection(INSPECTED[s].get(lang, "").split())) for s in SUBJECTS}
        best = max(SUBJECTS, key=hits.__getitem__)
        out.append(best if hits[best] >= least_terms else None)
    return out


def document_subjects(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", low: float = 0.002, high: float = 0.3, least_documents: int = 3, least_tokens: float = 3.0, least_share: float = 0.1, alpha: float = 0.1, rounds: int = 6, steps: int = 6) -> DataFrame:
    """(id_column, subject) of every subject of every document."""
    all_bags = materialise(word_bags(df, id_column, text_column), "all_bags")
    bags = materialise(all_bags.groupBy("key").agg(F.any_value(F.struct("lang", "words", "counts")).alias("bag")).select("key", "bag.*"), "bags")
    words = vocabulary(bags, low, high, least_documents)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("subject", T.StringType())])
    if not words:
        return df.sparkSession.createDataFrame([], T.StructType([df.schema[id_column], schema["subject"]]))
    encoded = materialise(encode_bags(bags, words, "key"), "encoded")
    weights = fit_topics(encoded, words, rounds=rounds, steps=steps, alpha=alpha)
    subjects = {lang: subject_of_topics(w, words[lang], lang) for lang, w in weights.items()}
    belongs = {lang: np.array([[s == subject for subject in SUBJECTS] for s in names], float) for lang, names in subjects.items()}
    model = df.sparkSession.sparkContext.broadcast({lang: np.exp(digamma(w) - digamma(w.sum(1))[:, None]) for lang, w in weights.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang, free in model.value.items():
                part = batch.take(pa.array(np.flatnonzero(langs == lang)))
                for at in range(0, part.num_rows, 2000):
                    few = part.slice(at, 2000)
                    mass, _, _ = infer(few.column(2), few.column(3), free, alpha, steps)
                    tokens = mass @ belongs[lang]
                    row, subject = np.nonzero((tokens >= least_tokens) & (tokens >= least_share * tokens.sum(1)[:, None]))
                    yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(row)), pa.array([SUBJECTS[s] for s in subject], pa.string())], names=schema.fieldNames())

    found = encoded.select("key", "lang", "terms", "counts").mapInArrow(assign, schema).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = all_bags.select(F.col(id_column).alias("_id"), "key", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int").alias("salt"))
    return members.join(found, ["key", "salt"]).select(F.col("_id").alias(id_column), "subject").distinct()
