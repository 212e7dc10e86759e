"""Languages of documents, pages, name lists and segments (problem 7).

Script ranges narrow a word's candidate languages; a hashed feature model
(the word and its letter trigrams), counted over all labelled documents, gives
per-word scores; Viterbi with a switching penalty labels the words of a text,
so mixed texts come out as spans. Texts of similar length are decoded together
in one array, a step for each word place.

Defined results: NULL, empty and letterless texts have language NULL and
confidence 0; repeated rows give repeated rows; an empty table an empty result
(and a model without counts, which then goes by script alone).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.batches import map_rows
from warraq.operators.multivalue import AUTHORS, split_values

LANGS = ("ar", "fa", "en", "fr", "tr")
BUCKETS = 1 << 16
SWITCH = 7.0
FOREIGN_SCRIPT = -4.0

_LATIN, _ARABIC = np.array([0, 0, 1, 1, 1], bool), np.array([1, 1, 0, 0, 0], bool)
_ZERO = "​-‏⁠﻿­"
WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_ZERO}̀-ًͯ-ٰٕ]|['’](?=[^\W\d_]))*")
_IS_ARABIC = re.compile("[؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ]")
_IS_LATIN = re.compile("[A-Za-zÀ-ɏｆＡ-Ｚａ-ｚﬀ-ﬆ]")

#: Names of the languages, besides codes.
NAMES = {
    "ar": "ar ara arb arabic arabe arapça العربية عربي عربية عربی", "fa": "fa fas per persian farsi persan farsça فارسی فارسي الفارسية",
    "en": "en eng english anglais ingilizce الإنجليزية إنجليزي انگلیسی", "fr": "fr fra fre french français francais fransızca الفرنسية فرنسي فرانسوی",
    "tr": "tr tur turkish türkçe turkce turc التركية تركي ترکی",
}
UNKNOWN = frozenset(["", "und", "n/a", "na", "nan", "xx", "unknown", "none", "null", "-", "?", "zxx", "mis", "mul", "غير معروف", "unk"])
_CODES = {n: code for code, names in NAMES.items() for n in names.split()}


def label_code(label: Column) -> Column:
    """The language a label names, in its code; NULL for a missing or unknown one, "other" for any further language."""
    low = F.lower(F.trim(label))
    base = F.split(low, "[-_]").getItem(0)
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return F.when(label.isNull() | low.isin(*UNKNOWN), None).otherwise(F.coalesce(codes[low], codes[base], F.lit("other")))


def features(word: str) -> list[int]:
    """Buckets of a word and of its letter trigrams."""
    w = f"<{word}>"
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in [w, *(w[i : i + 3] for i in range(len(w) - 2))]]


def plain(word: str) -> str:
    """A word in lower case and compatibility form, without invisible characters and marks."""
    if not word.isascii():
        word = re.sub(rf"[{_ZERO}ً-ٟ]", "", unicodedata.normalize("NFKC", word))
    return word.lower().replace("i̇", "i")


def word_fold() -> Callable[[np.ndarray, list, list], None]:
    """A function that adds the features of labelled texts to counters (a row for each language)."""
    known: dict[str, list[int]] = {}

    def fold(sums: np.ndarray, texts: list, codes: list) -> None:
        words = {code: Counter() for code in LANGS}
        for t, code in zip(texts, codes):
            if t and code in words:
                words[code].update(WORD.findall(t))
        for k, code in enumerate(LANGS):
            at: list[int] = []
            n: list[int] = []
            for w, count in words[code].items():
                f = known.get(w)
                if f is None:
                    if len(known) > 200_000:
                        known.clear()
                    f = known[w] = features(plain(w))
                at += f
                n += [count] * len(f)
            np.add.at(sums[k], np.array(at, np.int64), np.array(n, np.int64))

    return fold


def log_probabilities(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """The model: log-probabilities of each bucket under each language."""
    return np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)


def train(documents: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log-probabilities of each bucket under each language, from all labelled texts.

    At most ``BUCKETS`` rows for each language come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, fold = np.zeros((len(LANGS), BUCKETS), np.int64), word_fold()
        for batch in batches:
            fold(sums, batch.column(0).to_pylist(), batch.column(1).to_pylist())
        k, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k * BUCKETS + b, pa.int32()), pa.array(sums[k, b], pa.int64())], names=["at", "n"])

    rows = documents.select(F.col(text).alias("text"), label_code(F.col(lang)).alias("code")).filter(F.col("code").isin(*LANGS))
    got = rows.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(LANGS) * BUCKETS)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return log_probabilities(counts.reshape(len(LANGS), BUCKETS))


class Labeller:
    """Viterbi labels of the words of texts."""

    def __init__(self, model: np.ndarray, switch: float = SWITCH, only: tuple[str, ...] = LANGS) -> None:
        """``only``: the languages that a text may be in."""
        self.model, self.switch = model, switch
        self.open = np.array([k in only for k in LANGS])
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(LANGS)), np.float32)

    def _index(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.known)
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            w = plain(word)
            arabic, latin = bool(_IS_ARABIC.search(word)), bool(_IS_LATIN.search(word))
            if not arabic and not latin or len(w) == 0:  # no language speaks for it
                self.scores[at] = 0
            else:
                allowed = ((_ARABIC & arabic) | (_LATIN & latin)) & self.open
                f = self.model[:, features(w)]
                s = 1.5 * (f[:, 1:].mean(axis=1) if f.shape[1] > 1 else f[:, 0]) + 0.5 * f[:, 0]
                s = s - s[allowed].max()
                self.scores[at] = np.where(allowed, np.maximum(s, -5), FOREIGN_SCRIPT - 1)
        return at

    def paths(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of words the language index of each word, and the words' scores."""
        if len(self.known) > 400_000:
            self.known.clear()
        index = self._index
        ids = [np.fromiter((index(w) for w in words), np.int32, count=len(words)) for words in texts]
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int8), np.zeros((0, len(LANGS)), np.float32))] * len(texts)
        order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: len(ids[k]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(ids[order[end]]) <= 400_000:
                end += 1
            some = order[start:end]
            width = len(ids[some[-1]])
            emitted = np.zeros((width, len(some), len(LANGS)), np.float32)
            for col, k in enumerate(some):
                emitted[: len(ids[k]), col] = self.scores[ids[k]]
            best = emitted[0].copy()
            came = np.zeros((width, len(some), len(LANGS)), np.int8)
            stay = np.arange(len(LANGS), dtype=np.int8)
            for t in range(1, width):
                top = best.argmax(axis=1)
                jump = best[np.arange(len(some)), top][:, None] - self.switch
                came[t] = np.where(best >= jump, stay, top[:, None])
                best = np.maximum(best, jump) + emitted[t]
            state = best.argmax(axis=1)
            path = np.zeros((width, len(some)), np.int8)
            rows = np.arange(len(some))
            for t in range(width - 1, -1, -1):
                path[t] = state
                state = came[t, rows, state]
            for col, k in enumerate(some):
                out[k] = (path[: len(ids[k]), col], emitted[: len(ids[k]), col])
            start = end
        return out


def _confidence(scores: np.ndarray, lang: int) -> float:
    """How far the words speak for a language rather than the next best: logistic of the mean margin."""
    total = scores.mean(axis=0)
    margin = float(total[lang] - np.delete(total, lang).max())
    return round(1 / (1 + float(np.exp(-4 * margin))), 4)


def main_language(path: np.ndarray, scores: np.ndarray, words: list[str]) -> tuple[str | None, float]:
    """The language of most letters, and its confidence; NULL and 0 without letters."""
    if not len(path) or not np.any(scores):
        return None, 0.0
    letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(LANGS))
    k = int(letters.argmax())
    mine = path == k
    return LANGS[k], round(_confidence(scores[mine], k) * float(letters[k] / letters.sum()), 4)


def identify(df: DataFrame, key: str, text: str, model: np.ndarray) -> DataFrame:
    """(key, lang, confidence) of every row."""

    def make() -> Callable[..., tuple]:
        labeller = Labeller(model)

        def each(keys: list, texts: list) -> tuple:
            words = [WORD.findall(t) if t else [] for t in texts]
            found = [main_language(p, s, w) for (p, s), w in zip(labeller.paths(words), words)]
            return keys, [f[0] for f in found], [f[1] for f in found]

        return each

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return map_rows(rows, make, f"`{key}` bigint, lang string, confidence double", pa.schema([(key, pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))


def segments(df: DataFrame, key: str, text: str, model: np.ndarray) -> DataFrame:
    """(key, seg_no, start, end, lang, confidence): the spans of one language of each text, by character offsets."""
    columns = [(key, pa.int64()), ("seg_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]

    def make() -> Callable[..., tuple]:
        labeller = Labeller(model)

        def each(keys: list, texts: list) -> tuple:
            found = [list(WORD.finditer(t)) if t else [] for t in texts]
            rows = []
            for key_, ms, (path, scores) in zip(keys, found, labeller.paths([[m.group() for m in ms] for ms in found])):
                if not len(path) or not np.any(scores):
                    continue
                cuts = [0, *(np.nonzero(np.diff(path))[0] + 1), len(path)]
                for no, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                    rows.append((key_, no, ms[a].start(), ms[b - 1].end(), LANGS[path[a]], _confidence(scores[a:b], int(path[a]))))
            return tuple(zip(*rows)) if rows else ([],) * len(columns)

        return each

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return map_rows(rows, make, f"`{key}` bigint, seg_no int, start int, end int, lang string, confidence double", pa.schema(columns))


#: Lines that open a list of keywords or of references; what they open is no sentence.
_NOT_PROSE = re.compile(
    r"^\s*(?:k[ec]y\s*-?w[oc]r(?:d|cl)s?|mots[\s-]*cl[ée]s?|anahtar\s+(?:kelime|sözcük)ler|(?:ال)?[كک]ل[مه]ا[تثن]\s+(?:ال)?\w+|\w+\s+(?:ال)?(?:مفتاحية|دالة)|(?:ال)?مفاتيح|کلید\s*واژه\w*|واژ\w+\s+کلیدی|کلمات\s+کلیدی|"
    r"references?|bibliograph\w+|références?|kaynak(?:lar|ça)|(?:ال)?مراجع|المصادر|منابع|مراجع)\s*[:：]",
    re.I,
)
_OPENS = re.compile(r"^\s*[^\s:：.]{2,20}(?:\s+[^\s:：.]{2,20}){0,2}\s*[:：]")
_RUNNING = re.compile(r"ISSN|\bvol\.?\s*\d|\bno\.\s*\d|(?:المجلد|مجلد|العدد|عدد)\s*\(?[\d٠-٩]|^\W*(?:ص|p)?\W*[\d٠-٩۰-۹]{1,5}\W*$", re.I)
_END = re.compile(r"[.!?؟]+(?=[\s»\")]|$)")


_UNSEEN = re.compile(f"[{_ZERO}]")
_WIDE, _DIGIT = re.compile("[！-￮]"), re.compile(r"\d")


def sentences(page: str) -> list[list[str]]:
    """The words of the whole sentences of a page: at least five up to an end mark, without keyword and reference lists, headers and page numbers."""
    kept: list[str] = []
    skipping = False
    page = _UNSEEN.sub("", page)
    page = unicodedata.normalize("NFKC", page) if _WIDE.search(page) else page
    for line in page.split("\n"):
        line = line.strip()
        # a running line has a number or the word that stands before it
        if not line or ((_DIGIT.search(line) or "ISSN" in line) and _RUNNING.search(line)):
            continue
        if ":" in line or "：" in line:
            if _NOT_PROSE.match(line):
                skipping = True
            elif skipping and _OPENS.match(line):
                skipping = False
        if skipping:
            # the list ends with its full stop at a line's end
            if line.endswith("."):
                skipping = False
                kept.append("\0")
            continue
        kept.append(line)
    out = []
    for block in "\n".join(kept).split("\0"):
        last = 0
        for m in _END.finditer(block):
            words = WORD.findall(block, last, m.end())
            last = m.end()
            if len(words) >= 5:
                out.append(words)
    return out


def page_languages(df: DataFrame, key: str, text: str, model: np.ndarray, share: float = 0.7) -> DataFrame:
    """(key, lang, sentences, confidence): languages in which a page has at least one whole sentence."""
    columns = [(key, pa.int64()), ("lang", pa.string()), ("sentences", pa.int32()), ("confidence", pa.float64())]

    def make() -> Callable[..., tuple]:
        labeller = Labeller(model)

        def each(keys: list, texts: list) -> tuple:
            # one path over the whole page, so a sentence is judged by its neighbours too
            per = [sentences(t) if t else [] for t in texts]
            rows = []
            for key_, words, (path, scores) in zip(keys, per, labeller.paths([[w for s in some for w in s] for some in per])):
                counts: dict[int, list[float]] = {}
                at = 0
                for s in words:
                    p, e = path[at : at + len(s)], scores[at : at + len(s)]
                    at += len(s)
                    n = np.bincount(p, minlength=len(LANGS))
                    # a title or name before the sentence may be of another language: its longest run decides
                    for k in np.nonzero(n >= max(5, min(share * len(s), 12)))[0]:
                        counts.setdefault(int(k), []).append(_confidence(e[p == k], int(k)))
                rows += [(key_, LANGS[k], len(c), round(float(np.mean(c)), 4)) for k, c in sorted(counts.items())]
            return tuple(zip(*rows)) if rows else ([],) * len(columns)

        return each

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return map_rows(rows, make, f"`{key}` bigint, lang string, sentences int, confidence double", pa.schema(columns))


def name_list_languages(df: DataFrame, key: str, authors: str, model: np.ndarray) -> DataFrame:
    """(key, lang, confidence): the languages, ``ar`` or ``en``, in which a packed list has a name; confidence is the share of its names.

    Each name is a text of its own to the labeller, which may take these two
    languages alone: names of one script are written alike in all of its languages.
    """
    columns = [(key, pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]

    def make() -> Callable[..., tuple]:
        labeller = Labeller(model, only=("ar", "en"))
        known: dict[str, frozenset[int]] = {}

        def each(keys: list, lists: list) -> tuple:
            if len(known) > 200_000:
                known.clear()
            new = list({n for names in lists for n in names if n not in known})
            words = [[w for w in WORD.findall(n) if _NAME_SCRIPT.search(w)] for n in new]
            # a single Latin letter may be a footnote's sign, unless a stop makes it an initial
            words = [[] if ws and all(len(w) == 1 and w.isascii() for w in ws) and not _INITIAL.search(n) else ws for n, ws in zip(new, words)]
            known.update((n, frozenset(p.tolist())) for n, (p, _) in zip(new, labeller.paths(words)))
            rows = []
            for k, names in zip(keys, lists):
                n = Counter(lang for name in names for lang in known[name])
                rows += [(k, LANGS[lang], round(c / len(names), 4)) for lang, c in sorted(n.items())]
            return tuple(zip(*rows)) if rows else ([],) * len(columns)

        return each

    items = df.select(F.col(key).cast("bigint").alias(key), split_values(F.col(authors), AUTHORS).alias("items")).filter(F.size("items") > 0)
    return map_rows(items, make, f"`{key}` bigint, lang string, confidence double", pa.schema(columns))


_INITIAL = re.compile(r"[A-Z]\.")
_NAME_SCRIPT = re.compile("(?P<ar>[ء-يٱ-ۓﭐ-﷿ﹰ-ﻼ])|(?P<en>[A-Za-zＡ-Ｚａ-ｚ])")


def name_list_segments(df: DataFrame, key: str, authors: str) -> DataFrame:
    """(key, seg_no, start, end, lang, confidence): the spans of a packed list in ``ar`` and ``en``, by script as in ``name_list_languages``; confidence is the share of their words in that script."""
    columns = [(key, pa.int64()), ("seg_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]

    def make() -> Callable[..., tuple]:
        def each(keys: list, texts: list) -> tuple:
            rows = []
            for key_, text in zip(keys, texts):
                spans: list[list] = []
                for m in WORD.finditer(text or ""):
                    script = _NAME_SCRIPT.search(m.group())
                    lang = script.lastgroup if script else None
                    if lang and (not spans or spans[-1][2] != lang):
                        spans.append([m.start(), m.end(), lang, 0, 0])
                    if spans:
                        spans[-1][3] += bool(lang)
                        spans[-1][4] += 1
                        if lang:
                            spans[-1][1] = m.end()
                rows += [(key_, no, a, b, lang, round(k / n, 4)) for no, (a, b, lang, k, n) in enumerate(spans, 1)]
            return tuple(zip(*rows)) if rows else ([],) * len(columns)

        return each

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(authors).alias("text"))
    return map_rows(rows, make, f"`{key}` bigint, seg_no int, start int, end int, lang string, confidence double", pa.schema(columns))
