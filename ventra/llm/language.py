"""Language of documents and of their stretches of cues: known words first, then ever shorter letter groups."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: ISO 639-1 codes of three-letter codes and names.
CODES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français", "es": "spa spanish español castellano",
    "pt": "por portuguese português", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "ru": "rus russian русский",
    "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor nob nno norwegian norsk", "fi": "fin finnish suomi",
    "pl": "pol polish polski", "cs": "ces cze czech", "sk": "slk slo slovak", "hu": "hun hungarian magyar", "ro": "ron rum romanian",
    "bg": "bul bulgarian", "uk": "ukr ukrainian", "sr": "srp serbian", "hr": "hrv croatian", "sl": "slv slovenian", "el": "ell gre greek",
    "tr": "tur turkish türkçe", "ar": "ara arabic", "he": "heb hebrew", "fa": "fas per persian", "hi": "hin hindi", "zh": "zho chi chinese",
    "ja": "jpn japanese", "ko": "kor korean", "vi": "vie vietnamese", "th": "tha thai", "id": "ind indonesian", "ca": "cat catalan",
    "eu": "eus baq basque", "gl": "glg galician", "et": "est estonian", "lv": "lav latvian", "lt": "lit lithuanian",
}
NO_LANGUAGE = {"", "und", "unknown", "none", "null", "n/a", "na", "nan", "mul", "mis", "zxx", "xx", "-", "?", "other"}
_BY_NAME = {name: code for code, names in CODES.items() for name in names.split()}


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label in any of its forms, None for no language, the text itself if unknown."""
    text = (label or "").strip().lower()
    if text in NO_LANGUAGE:
        return None
    first = re.split(r"[-_ (]", text)[0]
    return _BY_NAME.get(text) or _BY_NAME.get(first) or first


TIME_LINE = re.compile(r"[^\n\d-]*-?\d+:\d{1,2}:\d{1,2}[,.]\d+[ \t]*-->")
_TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_SITES = ("://", "www.", ".com", ".org", ".net", ".invalid", ".example")
_LINK = re.compile(r"\S*(?:www\.|://)\S*|\S+\.(?:com|org|net|invalid|example)\S*")
_WORD = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile("[ÂÃÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ�]|[À-ÿ]{4}")
#: Letters that are frequent in Russian, to tell which reading of the bytes is right.
_RUSSIAN = set("оеаинтсрвлкмдпуыья ")


def cues_of(text: str) -> list[str]:
    """Texts of the cues, each from its time line to the next; a text without time lines is one cue."""
    ends, starts = [], []
    at = text.find("-->")
    while at >= 0:
        line, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        if TIME_LINE.match(text, line, end):
            starts.append(line)
            ends.append(end)
        at = text.find("-->", end)
    return [text[a:b] for a, b in zip(ends, [*starts[1:], len(text)])] if ends else [text]


def repaired(text: str) -> str:
    """Text whose bytes were read in a wrong encoding, as far as that shows."""
    if not _BROKEN.search(text):
        return text
    raw = bytearray()
    for ch in text:
        if ord(ch) < 256:
            raw.append(ord(ch))
        else:
            try:
                raw += ch.encode("cp1252")
            except UnicodeEncodeError:
                raw += b"?" if ch == "�" else ch.encode("utf-8")
    again = raw.decode("utf-8", "ignore")
    if len(_BROKEN.findall(again)) < len(_BROKEN.findall(text)) and again.count("Ã") + again.count("Ð") < text.count("Ã") + text.count("Ð"):
        return again
    letters = [c for c in text if c.isalpha()]
    if letters and sum(0xC0 <= ord(c) <= 0xFF for c in letters) > 0.6 * len(letters):
        readings = [bytes(raw).decode(e, "ignore") for e in ("koi8-r", "cp1251", "iso8859-5")]
        return max(readings, key=lambda r: sum(c in _RUSSIAN for c in r))
    return text


def _without_markup(text: str) -> str:
    if "<" in text or "{" in text:
        text = _TAG.sub(" ", text)
    return _LINK.sub(" ", text) if any(s in text for s in _SITES) else text


def words_of(cue: str) -> list[str]:
    return _WORD.findall(_without_markup(cue.lower()))


def cue_words(text: str) -> list[list[str]]:
    """Words of each cue.  Markup never reaches over a line break, so the text is cleaned before it is cut."""
    if not text.isascii() and _BROKEN.search(text):
        return [words_of(repaired(c)) for c in cues_of(text)]
    return [_WORD.findall(c) for c in cues_of(_without_markup(text.lower()))]


class Model:
    """Scores of words, and of letter groups for words not known, per language."""

    ORDERS = (5, 4, 3, 2, 1)

    def __init__(self, counts: dict[str, Counter], smoothing: float = 0.2, least: int = 2) -> None:
        self.languages = sorted(counts)
        vocabulary = sorted({w for c in counts.values() for w, n in c.items() if n >= least})
        self.words = {w: i for i, w in enumerate(vocabulary)}
        table = np.array([[counts[x].get(w, 0) for x in self.languages] for w in vocabulary], np.float32).reshape(len(vocabulary), len(self.languages))
        self.scores = self._relative(table, smoothing)
        # a letter group counts by the words it is in, each word by the log of its count, so that a
        # few frequent words don't stand for the whole language
        self.groups: list[dict[str, int]] = []
        self.group_scores: list[np.ndarray] = []
        weight = np.log1p(table)
        for order in self.ORDERS:
            index: dict[str, int] = {}
            at, row = [], []
            for w, i in self.words.items():
                for g in self._grams(w, order):
                    at.append(index.setdefault(g, len(index)))
                    row.append(i)
            sums = np.zeros((len(index), len(self.languages)), np.float32)
            if at:
                np.add.at(sums, at, weight[row])
            self.groups.append(index)
            self.group_scores.append(self._relative(sums, 0.5))
        self.unseen: dict[str, np.ndarray] = {}

    def state(self) -> dict:
        """What the model consists of, in plain types, to be sent to tasks."""
        return {k: v for k, v in self.__dict__.items() if k != "unseen"}

    @classmethod
    def of(cls, state: dict) -> Model:
        m = cls.__new__(cls)
        m.__dict__.update(state, unseen={})
        return m

    @staticmethod
    def _grams(word: str, order: int) -> list[str]:
        padded = f" {word} " if order > 1 else word
        return [padded[i : i + order] for i in range(len(padded) - order + 1)]

    @staticmethod
    def _relative(table: np.ndarray, smoothing: float) -> np.ndarray:
        """Log frequencies less the log of their mean over languages, kept within bounds."""
        if not len(table):
            return table
        freq = (table + smoothing) / (table.sum(axis=0) + smoothing * len(table))
        return np.clip(np.log(freq) - np.log(freq.mean(axis=1, keepdims=True)), -6, 3).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        """Score of an unseen word: mean over its longest known letter groups."""
        got = self.unseen.get(word)
        if got is None:
            got = np.zeros(len(self.languages), np.float32)
            for order, index, scores in zip(self.ORDERS, self.groups, self.group_scores):
                at = [index[g] for g in self._grams(word, order) if g in index]
                if at:
                    got = scores[at].mean(axis=0) * min(2.0, len(word) / 4)
                    break
            if len(self.unseen) > 200_000:
                self.unseen.clear()
            self.unseen[word] = got
        return got

    def cue_scores(self, cues: list[list[str]]) -> np.ndarray:
        """Score of each cue per language; zeros for a cue without words."""
        out = np.zeros((len(cues), len(self.languages)), np.float32)
        flat = [w for words in cues for w in words]
        if not flat:
            return out
        get = self.words.get
        ids = np.array([get(w, -1) for w in flat], np.int64)
        rows = self.scores[np.maximum(ids, 0)] if len(self.scores) else np.zeros((len(flat), len(self.languages)), np.float32)
        for i in np.flatnonzero(ids < 0):
            rows[i] = self.backoff(flat[i])
        lengths = np.array([len(c) for c in cues])
        filled = np.flatnonzero(lengths)
        starts = np.cumsum(lengths)[filled] - lengths[filled]
        out[filled] = np.add.reduceat(rows, starts, axis=0)
        return out


LEAST_RUN = 3  # cues that make a stretch
SWITCH = 6.0  # cost of a change of language, in units of log likelihood
CAP = 8.0  # most that one cue can say against a language


def segments(scores: np.ndarray, filled: np.ndarray) -> list[tuple[int, int]]:
    """(first cue, language) of each stretch, cheapest over all ways to cut the cues with words.

    No stretch has fewer than ``LEAST_RUN`` cues (all cues, if there are fewer), so a shorter
    insertion is left to the stretch around it; a cue without words goes with the one before.
    """
    at = np.flatnonzero(filled)
    x = scores[at]
    loss = np.minimum(x.max(axis=1, keepdims=True) - x, CAP)
    n, k = loss.shape
    total = loss.sum(axis=0)
    # a cue with words counts with those without that follow it, the first also with those before it
    weight = np.diff(np.r_[0, at[1:], len(filled)])
    best = int(total.argmin())
    if len(filled) < 2 * LEAST_RUN or k < 2 or total[best] <= SWITCH:
        return [(0, best)]
    # what a run of cues can save in another language, at most.  A cut with f stretches not in the best
    # language has f changes, or f - 1 of at least one if no stretch is in it: no more than f / 2 pay
    saved = np.cumsum(np.vstack([np.zeros(k), loss[:, [best]] - loss]), axis=0)
    if (saved - np.minimum.accumulate(saved, axis=0)).max() <= SWITCH / 2:
        return [(0, best)]
    # cost[d][l]: in language l for d+1 cues so far; the last d stands for LEAST_RUN or more
    top = LEAST_RUN - 1
    cost = np.full((LEAST_RUN, k), np.inf)
    cost[min(weight[0] - 1, top)] = loss[0]
    came = np.full((n, LEAST_RUN, k), -1, np.int64)  # d before, or LEAST_RUN + the language before where a stretch begins
    for i in range(1, n):
        order = np.argsort(cost[top], kind="stable")[:2]
        source = np.where(order[0] == np.arange(k), order[-1], order[0])
        new = np.full_like(cost, np.inf)
        for d in range(LEAST_RUN):
            to = min(d + weight[i], top)
            better = cost[d] < new[to]
            new[to] = np.where(better, cost[d], new[to])
            came[i, to] = np.where(better, d, came[i, to])
        to = min(weight[i] - 1, top)
        fresh = cost[top][source] + SWITCH
        better = fresh < new[to]
        new[to] = np.where(better, fresh, new[to])
        came[i, to] = np.where(better, LEAST_RUN + source, came[i, to])
        cost = new + loss[i]
    lang, d = int(cost[top].argmin()), top
    out = []
    for i in range(n - 1, 0, -1):
        before = int(came[i, d, lang])
        if before >= LEAST_RUN:
            out.append((int(at[i]), lang))
            d, lang = top, before - LEAST_RUN
        else:
            d = before
    out.append((0, lang))
    return out[::-1]


def _documents(batch: pd.DataFrame) -> Iterator[tuple[int, list[list[str]]]]:
    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        yield doc_id, cue_words(text or "")


def _labelled(documents: DataFrame) -> DataFrame:
    code = F.pandas_udf(lambda s: s.map(label_code), "string")
    return documents.select("doc_id", code("lang").alias("label"))


def _word_counts(sample: DataFrame, fitted: Model | None) -> dict[str, Counter]:
    """Words per language; with a model only from cues it gives the document's own language."""
    sent = sample.sparkSession.sparkContext.broadcast(fitted.state() if fitted else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        model = Model.of(sent.value) if sent.value else None
        for batch in batches:
            for (_, cues), label in zip(_documents(batch), batch["label"]):
                c = sums.setdefault(label, Counter())
                if model is None:
                    for words in cues:
                        c.update(words)
                    continue
                if label not in model.languages:
                    continue
                own = model.languages.index(label)
                for words, best in zip(cues, model.cue_scores(cues).argmax(axis=1)):
                    if best == own:
                        c.update(words)
        for label, c in sums.items():
            yield pd.DataFrame({"label": label, "word": list(c), "n": list(c.values())})

    counts = sample.mapInPandas(count, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {}
    for r in counts.where("n > 1").collect():  # bounded by the sample
        out.setdefault(r.label, Counter())[r.word] = r.n
    return {k: Counter(dict(c.most_common(WORDS_PER_LANGUAGE))) for k, c in out.items()}


SAMPLE = 600  # documents per language the model is fitted on
WORDS_PER_LANGUAGE = 40_000  # most frequent words that the model keeps
LEAST = 3  # labelled documents that a language needs
LEAST_SHARE = 0.004  # of labelled documents; a language with less must be confirmed by its own documents
#: ISO 639-1.
ISO = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to "
    "tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)


def _confirmed(sample: DataFrame, rare: list[str]) -> set[str]:
    """Those of ``rare`` that at least half of their documents are in, as found by a model fitted on the other
    half of the sample; at least two documents must be."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("doc_id"))  # of a label's sample, which is bounded
    halves = durable(sample.withColumn("half", place % 2))
    schema = "label string, own bigint, n bigint"
    votes: dict[str, list[int]] = {}
    for half in (0, 1):
        fitted = halves.where(F.col("half") != half).drop("half")
        model = Model(_word_counts(fitted, None))
        model = Model(_word_counts(fitted, model))
        sent = sample.sparkSession.sparkContext.broadcast(model.state())

        def vote(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            m = Model.of(sent.value)
            for batch in batches:
                rows = []
                for (_, cues), label in zip(_documents(batch), batch["label"]):
                    if any(cues):
                        rows.append((label, int(m.languages[m.cue_scores(cues).sum(axis=0).argmax()] == label), 1))
                yield pd.DataFrame(rows, columns=["label", "own", "n"])

        test = halves.where((F.col("half") == half) & F.col("label").isin(rare)).drop("half")
        for r in test.mapInPandas(vote, schema).groupBy("label").agg(F.sum("own").alias("own"), F.sum("n").alias("n")).collect():
            v = votes.setdefault(r.label, [0, 0])
            v[0], v[1] = v[0] + r.own, v[1] + r.n
    return {k for k, (own, n) in votes.items() if own >= 2 and 2 * own >= n}


def fit_languages(documents: DataFrame, per_language: int = SAMPLE) -> Model:
    """A model from a bounded sample: about ``per_language`` documents of each label, chosen by a hash
    of their id.  A rare label is a language if documents of it, held out, confirm it.  Labels may be wrong: the model is fitted again on the cues in which it agrees
    with the label.  What reaches the driver are the sample's word counts."""
    codes = _labelled(documents).where("label is not null")
    # labels are free text: only codes reach the driver, 184 at most
    n = {r.label: r["count"] for r in codes.where(F.col("label").isin(sorted(ISO))).groupBy("label").count().collect()}
    n = {k: v for k, v in n.items() if v >= LEAST}
    rare = [k for k, v in n.items() if v < LEAST_SHARE * sum(n.values())]
    if not n:
        return Model({"en": Counter({"the": 2})})
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    code = F.pandas_udf(lambda s: s.map(label_code), "string")
    sample = documents.select("doc_id", "text", code("lang").alias("label"))
    sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)
    sample = durable(sample)  # read three times
    if rare:
        refused = set(rare) - _confirmed(sample, rare)
        sample = sample.where(~F.col("label").isin(list(refused))) if refused else sample
    model = Model(_word_counts(sample, None))
    for _ in range(2):
        model = Model(_word_counts(sample, model))
    return model


_OUT = "doc_id bigint, cue_no int, lang string, confidence double, n_cues int, label string, n_stretches int"


def label_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of each document (``cue_no`` 0) and, where it has several, of each stretch of cues.

    Returns ``doc_id, cue_no, lang, confidence, n_cues, label, n_stretches``: ``lang`` of a document is
    that of most of its cues; a stretch has the number of its first cue and is at least three cues
    long; ``label`` is the code the document came with.  ``confidence`` is the posterior probability
    of the language under the model, per word, times the share of cues in it for documents.

    Null and empty texts and texts without words have a row with null ``lang``; texts without time
    lines are one cue; repeated rows are labelled each; other columns are ignored; texts are read
    whole, however long, one at a time.  No shuffle: the model (bounded) goes to the documents.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model or fit_languages(documents.select("doc_id", "text", "lang"))).state())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.of(sent.value)
        names = [c.split()[0] for c in _OUT.split(", ")]
        for batch in batches:
            rows = []
            for (doc_id, cues), lang in zip(_documents(batch), batch["lang"]):
                given = label_code(lang)
                filled = np.array([bool(c) for c in cues], bool)
                if not filled.any():
                    rows.append((doc_id, 0, None, None, len(cues), given, 0))
                    continue
                scores = m.cue_scores(cues)
                n_words = np.array([len(c) for c in cues])
                parts = segments(scores, filled)
                ends = [*[p[0] for p in parts[1:]], len(cues)]
                sizes = Counter()
                made = []
                for (first, k), end in zip(parts, ends):
                    sizes[k] += end - first
                    per_word = scores[first:end].sum(axis=0) / max(1, n_words[first:end].sum())
                    p = np.exp(per_word - per_word.max())
                    made.append((first, k, end - first, float(p[k] / p.sum())))
                main = max(sizes, key=lambda k: sizes[k])  # the earlier of equals
                sure = sum(c * s for _, k, s, c in made if k == main) / len(cues)
                rows.append((doc_id, 0, m.languages[main], sure, len(cues), given, len(parts)))
                if len(parts) > 1:
                    rows += [(doc_id, first + 1, m.languages[k], c, s, given, len(parts)) for first, k, s, c in made]
            yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "text", "lang").mapInPandas(label, _OUT)
