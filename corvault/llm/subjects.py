"""Subject areas of documents.

Method: a multi-pattern automaton finds weighted subject terms.  The terms are curated seeds and words
that stand out in labelled documents of a subject (:func:`learned`) and, over all documents, words that keep
company with these (:func:`spread`); a term weighs more the rarer it is in the corpus, and less if several
subjects share it.  A sentence is about a subject if the terms of it reach
``SENTENCE``; one passing mention doesn't.  The number of such sentences is normalised by the length of the
document in sentences, and every subject whose share reaches its own calibrated threshold is assigned.

Null, empty and blank texts have no subject.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.runtime import checkpoint

#: Weight of a term that stands for one subject, and of one that several share; rarity raises it up to so many times.
OWN, SHARED, RAREST = 1.0, 0.75, 1.25
#: Weight that makes a sentence one about the subject.
SENTENCE = 1.5
#: Share of a document's sentences from which a subject is assigned where there are too few labels to calibrate it.
SHARE = 0.22
#: Labelled documents that a model is fitted on, at most; those with the least hashes.
MOST_LABELLED = 4_000
#: A learned term stands in so many labelled documents of its subject, and is so many times as frequent there as elsewhere.
LEAST_DOCUMENTS, LIFT = 4, 4.0
#: Of all sentences with a word, so many and such a part hold other terms of a subject if it is to be a term of it; terms of a subject at most.
LEAST_SENTENCES, PRECISION, MOST_TERMS = 8, 0.45, 2_000
#: Documents of a subject from which its threshold is calibrated.
LEAST_POSITIVE = 20

#: Curated seeds of each subject, general words for it in English, German and Chinese.
SEEDS = {
    "agriculture": "harvest crop livestock soil irrigation tractor ernte acker landwirt saatgut 农业 作物 灌溉 土壤",
    "culture": "museum theatre orchestra novel painting exhibition konzert gemälde bühne roman 博物馆 艺术 音乐 展览",
    "defence": "army brigade artillery missile submarine battalion soldat panzer kaserne bundeswehr 军队 导弹 潜艇 演习",
    "education": "teacher curriculum classroom exam university pupil schule lehrer unterricht hochschule 学校 教师 课程 考试",
    "energy": "turbine reactor electricity pipeline voltage refinery kraftwerk strom netzspannung windrad 电网 发电 电压 燃料",
    "finance": "bond dividend mortgage audit loan treasury zins anleihe bilanz kredit 债券 贷款 利率 审计",
    "health": "patient vaccine surgeon diagnosis therapy infection arzt impfung patient krankenhaus 患者 疫苗 手术 诊断",
    "law": "court plaintiff defendant verdict statute attorney gericht urteil klage anwalt 法院 判决 律师 诉讼",
    "science": "microscope molecule experiment hypothesis laboratory telescope versuch molekül labor forschung 实验 分子 显微镜 假说",
    "software": "compiler database server algorithm repository deployment datenbank quellcode rechner schnittstelle 代码 数据库 服务器 编译器",
    "sport": "goalkeeper tournament championship referee marathon striker verein trainer torwart meisterschaft 比赛 球队 冠军 裁判",
    "transport": "railway freight harbour locomotive highway ferry bahnhof güterzug fähre autobahn 铁路 港口 货运 隧道",
}

_END = re.compile(r"(?<=[.!?])[\"”’)]*\s+(?=\S)|[。！？]+|\r?\n[ \t]*\r?\n")
_CONTENT = re.compile("[一-鿿]{4}|[^\\W\\d_]{2}\\W[^\\n]*?[^\\W\\d_]{2}")
_LATIN, _HAN = re.compile("[^\\W\\d_一-鿿]{3,}"), re.compile("[一-鿿]+")


def sentences(text: str) -> list[str]:
    """The sentences of ``text``; a scrap of one word isn't counted."""
    return [s for s in _END.split(text) if s and _CONTENT.search(s)]


def words(sentence: str) -> set[str]:
    """What may be a term in a sentence in small letters: words of three letters or more, and every two ideographs side by side."""
    found = set(_LATIN.findall(sentence))
    if not sentence.isascii():
        found |= {r[i : i + 2] for r in _HAN.findall(sentence) for i in range(len(r) - 1)}
    return found


@dataclass
class Model:
    """Weights of terms for subjects, and the thresholds of subjects; small and of bounded size, so it can be sent to the workers."""

    weights: dict[str, dict[str, float]]
    thresholds: dict[str, float] = field(default_factory=dict)

    def matcher(self) -> Matcher:
        return Matcher(self.weights)


class Matcher:
    def __init__(self, weights: dict[str, dict[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for w, own in weights.items():
            self.automaton.add_word(w, (len(w), tuple(own.items()), w[0] < "　", w))
        self.automaton.make_automaton()

    def terms(self, text: str) -> Iterator[tuple[str, tuple[tuple[str, float], ...]]]:
        """Terms of a text in small letters; words count only as a whole, and terms of ideographs don't overlap."""
        free = 0
        for end, (n, own, alphabetic, w) in self.automaton.iter(text):
            begin = end + 1 - n
            if alphabetic:
                if (end + 1 < len(text) and text[end + 1].isalpha()) or (begin and text[begin - 1].isalpha()):
                    continue
            elif begin < free:
                continue
            else:
                free = end + 1
            yield w, own

    def sentence(self, text: str) -> Counter[str]:
        """Weight of each subject's terms."""
        found: Counter[str] = Counter()
        for _, own in self.terms(text):
            for s, weight in own:
                found[s] += weight
        return found

    def shares(self, text: str | None) -> dict[str, float]:
        """Share of the sentences that are about each subject."""
        own = sentences(text.lower()) if text else []
        about: Counter[str] = Counter()
        for s in own:
            for subject, weight in self.sentence(s).items():
                if weight >= SENTENCE - 1e-9:
                    about[subject] += 1
        return {s: n / len(own) for s, n in about.items()}


def seeded(seeds: dict[str, str] = SEEDS) -> Model:
    """The model of the seeds alone."""
    owners: dict[str, set[str]] = defaultdict(set)
    for s, line in seeds.items():
        for w in line.split():
            owners[w].add(s)
    return Model({w: {s: OWN if len(own) == 1 else SHARED for s in own} for w, own in owners.items()})


def learned(examples: list[tuple[str, set[str]]], seeds: dict[str, str] = SEEDS) -> dict[str, dict[str, float]]:
    """Seeds and the terms that stand out in documents of a subject, with their weights before rarity.

    ``examples``: texts with their subjects.  A term is counted in sentences, as a document of a subject has many sentences with its terms.
    """
    subjects = sorted({s for _, own in examples for s in own} | set(seeds))
    count = {s: Counter() for s in subjects}
    documents = {s: Counter() for s in subjects}
    total: Counter[str] = Counter()
    size = Counter()
    all_sentences = 0
    for text, own in examples:
        parts = [words(x) for x in sentences(text.lower())]
        held = Counter(w for p in parts for w in p)
        total.update(held)
        all_sentences += len(parts)
        for s in own & set(subjects):
            count[s].update(held)
            documents[s].update(held.keys())
            size[s] += len(parts)
    weights: dict[str, dict[str, float]] = {}
    rates: dict[str, dict[str, float]] = defaultdict(dict)
    for s in subjects:
        rest = max(1, all_sentences - size[s])
        for w, n in count[s].items():
            if documents[s][w] >= LEAST_DOCUMENTS:
                inside, outside = n / max(1, size[s]), (total[w] - n + 0.5) / rest
                if inside >= LIFT * outside:
                    rates[w][s] = inside
    for w, own in rates.items():
        best = max(own.values())
        kept = [s for s, r in own.items() if r >= 0.4 * best]
        weights[w] = {s: OWN if len(kept) == 1 else SHARED for s in kept}
    for w, own in seeded(seeds).weights.items():
        # a seed that labelled documents know and don't bear out is dropped
        if total[w] < 3 * LEAST_DOCUMENTS:
            weights.setdefault(w, own)
    return weights


def spread(weights: dict[str, dict[str, float]], rows: DataFrame, text_col: str) -> dict[str, dict[str, float]]:
    """``weights`` after one look at all texts of ``rows``: words that keep company with a subject's terms join them, terms that don't leave, rare ones weigh more.

    A word is counted for a subject in each sentence that holds another term of it.  What is collected are the words that pass, so many
    for each subject at most (``MOST_TERMS``).
    """
    plain = Model(weights)

    def count(batches) -> Iterator[pa.RecordBatch]:
        m = plain.matcher()
        # of words: sentences in all (""), documents ("-"), and sentences that hold another term of a subject
        held: dict[str, Counter[str]] = defaultdict(Counter)

        def out():
            for s_, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([s_] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "subject", "n"])
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                here: set[str] = set()
                for x in sentences(t.lower()):
                    own = words(x)
                    here |= own
                    own.add("")
                    held[""].update(own)
                    found = dict(m.terms(x))
                    if not found:
                        continue
                    total: dict[str, float] = defaultdict(float)
                    for o in found.values():
                        for s_, weight in o:
                            total[s_] += weight
                    for s_, weight in total.items():
                        # a term is no evidence for itself
                        alone = {w for w, o in found.items() if weight - sum(v for k, v in o if k == s_) < SENTENCE / 2}
                        held[s_].update(own - alone)
                here.add("")
                held["-"].update(here)
            if sum(map(len, held.values())) > 400_000:
                yield from out()
        yield from out()

    counted = checkpoint(rows.select(text_col).mapInArrow(count, "term string, subject string, n long").groupBy("term", "subject").agg(F.sum("n").alias("n")))
    base = {r.subject: r.n for r in counted.where("term = ''").collect()}
    every, texts = max(1, base.pop("", 1)), max(1, base.pop("-", 1))
    total = counted.where("subject = ''").select("term", F.col("n").alias("total"))
    docs = counted.where("subject = '-'").select("term", F.col("n").alias("docs"))
    rate = F.lit(1.0)
    for s_, n_ in base.items():
        rate = F.when(F.col("subject") == s_, n_ / every).otherwise(rate)
    part = F.col("n") / F.col("total")
    passed = counted.where("subject not in ('', '-') and term != ''").where(F.col("n") >= LEAST_SENTENCES).join(total, "term").where((part >= PRECISION) & (part >= LIFT * rate))
    best = Window.partitionBy("subject").orderBy(F.desc("n"), "term")
    passed = passed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= MOST_TERMS).join(docs, "term").select("term", "subject", part.alias("part"), "docs").collect()
    known = {r.term: r for r in docs.join(F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in weights] or [("",)], "term string")), "term").join(total, "term").collect()}
    parts: dict[str, dict[str, float]] = defaultdict(dict)
    df = {w: r.docs for w, r in known.items()}
    for r in passed:
        parts[r.term][r.subject] = r.part
        df[r.term] = r.docs
    # two ideographs across the border of words go where a much more frequent pair overlaps them
    often: dict[tuple[int, str], int] = {}
    for w in parts:
        if w[0] >= "\u3000":
            for side in (0, 1):
                often[side, w[side]] = max(often.get((side, w[side]), 0), df[w])
    for w in [w for w in parts if w[0] >= "\u3000" and max(often.get((1, w[0]), 0), often.get((0, w[1]), 0)) > 2 * df[w]]:
        del parts[w]
    made = {w: {s_: OWN if sum(x >= 0.4 * max(own.values()) for x in own.values()) == 1 else SHARED for s_, x in own.items() if x >= 0.4 * max(own.values())} for w, own in parts.items()}
    for w, own in weights.items():
        if w not in made and (w not in known or known[w].total < 2 * LEAST_SENTENCES):
            made[w] = own
    idf = {w: math.log((texts + 1) / (df.get(w, 0) + 1)) for w in made}
    order = sorted(idf.values())
    middle = order[len(order) // 2] if order else 1.0
    return {w: {s_: x * min(RAREST, max(1.0, idf[w] / middle if middle else 1.0)) for s_, x in own.items()} for w, own in made.items()}


def thresholds(examples: list[tuple[str, set[str]]], model: Model) -> dict[str, float]:
    """Of each subject the threshold that agrees best with the labels, the middle one of the best; for subjects with few labels ``SHARE``."""
    m = model.matcher()
    scored = [(m.shares(t), own) for t, own in examples]
    out = {}
    for s in sorted({x for own in model.weights.values() for x in own}):
        points = [(sh.get(s, 0.0), s in own) for sh, own in scored]
        positive = sum(y for _, y in points)
        if positive < LEAST_POSITIVE:
            continue
        f1 = {}
        for step in range(10, 41):
            t = step / 100
            hit = sum(1 for x, y in points if y and x >= t)
            said = sum(1 for x, _ in points if x >= t)
            f1[t] = 2 * hit / max(1, said + positive)
        best = max(f1.values())
        near = [t for t, v in f1.items() if v >= best - 0.002]
        out[s] = near[len(near) // 2]
    return out


def labelled(rows: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, most: int = MOST_LABELLED) -> list[tuple[str, set[str]]]:
    """Texts and subjects of at most ``most`` labelled documents, those with the least hashes of their ids.

    Labels are compared in lower case; "none" means no subject; repeated labels count once.
    """
    wanted = labels.select(F.col(id_col), F.lower(F.trim(label_col)).alias("subject")).where(f"subject is not null and {id_col} is not null")
    wanted = wanted.groupBy(id_col).agg(F.collect_set("subject").alias("truth")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    found = rows.select(id_col, text_col).where(F.length(text_col) > 0).join(F.broadcast(wanted), id_col).orderBy(F.xxhash64(id_col), id_col).collect()
    return [(r[1], set(r[2]) - {"none"}) for r in found]


def fit(rows: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, most: int = MOST_LABELLED) -> Model:
    """Terms, weights and thresholds: terms and thresholds from a bounded sample of labelled documents, rarity from all rows."""
    examples = labelled(rows, id_col, text_col, labels, label_col, most)
    model = Model(spread(learned(examples), rows, text_col))
    model.thresholds = thresholds(examples, model)
    return model


def shares(rows: DataFrame, id_col: str, text_col: str, chosen: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """(id, subject, share) for every subject that at least one sentence is about.  ``chosen``: a closed list of subjects."""
    model = model or seeded()
    allowed = set(chosen) if chosen is not None else {s for own in model.weights.values() for s in own}
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = sent.value.matcher()
        for b in batches:
            at, subject, share = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, x in m.shares(t).items():
                    if s in allowed:
                        at.append(i)
                        subject.append(s)
                        share.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(subject, pa.string()), pa.array(share, pa.float64())], ["id", "subject", "share"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, subject string, share double")


def assign(rows: DataFrame, id_col: str, text_col: str, chosen: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """(id, subject, share): every subject of each text at or above the subject's threshold."""
    model = model or seeded()
    limit = F.lit(SHARE)
    for s, t in model.thresholds.items():
        limit = F.when(F.col("subject") == s, t).otherwise(limit)
    return shares(rows, id_col, text_col, chosen, model).where(F.col("share") >= limit)


def composition(rows: DataFrame, id_col: str, text_col: str, chosen: list[str], model: Model | None = None) -> DataFrame:
    """(subject, documents, document_share, chars): the part of each subject in the corpus; a document counts for each of its subjects.

    Subjects without a document are kept with zeros; "none" stands for documents of no subject.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"), F.col(text_col).alias("text"))
    own = F.struct("id", "chars")
    said = checkpoint(assign(base.select(own.alias("own"), "text"), "own", "text", chosen, model).select("id.id", "id.chars", "subject"))
    found = said.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
    some = said.select("id").distinct().count()
    total = base.count()
    names = spark.createDataFrame([(s,) for s in chosen], "subject string")
    listed = names.join(found, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    return listed.withColumn("document_share", F.col("documents") / F.lit(max(1, total))).withColumn("without_subject", F.lit(total - some).cast("long"))
