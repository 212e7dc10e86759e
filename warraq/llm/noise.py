"""Noise in text from scanned pages (problem 1).

Lines of journal, issue, short-title or ISSN data and page numbers are taken
out, by their form or because they recur at the edges of many pages with other
numbers; words cut at a line end are joined, unless the corpus knows the two
parts as a compound; misread words are corrected by a noisy channel: character
confusion probabilities times the likelihood of corpus n-grams, decoded by
Viterbi over the candidate words of the page's lines. A word with a single
candidate cuts the chain, so each run of suspects is decoded between its two
neighbours, the line before or after included; the best path is the same. A
whole word read as Latin letters among Arabic ones may stand for any Arabic
word of the pages: where the words on both sides have been seen with one of
them far more than with all others, it is restored, else left. These words are
looked up once all pages are read, by joins over exact counts. Else unigram
and bigram counts of all pages are held in count-min sketches whose size
follows their measured noise up to a largest one.

Defined results: NULL and empty pages have no kinds and the text NULL or
empty; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm import sketch
from warraq.llm.batches import map_rows, partial_counts
from warraq.session import cut, stored

#: Letters that a recogniser takes for one another, by shape.
SHAPES = ("بتثني", "جحخ", "درذز", "سش", "صض", "طظ", "عغ", "فق", "مه", "ecо", "tf", "hb", "il1", "un", "کگ", "چجخح", "پبت", "ژزر")
#: Marks that a recogniser reads in the place of any letter.
MARKS = "|~^\\°!¦§¤"
#: A letter is misread with this probability; a mark stands for a given letter with the last one.
MISREAD, AS_MARK = 2e-3, 2e-4
#: Digits that a recogniser reads for letters.
DIGITS = {"0": "o", "1": "li", "5": "s"}
#: The share of the evidence that the best word for one read as a whole in other letters must have.
SURE = 0.6
#: A line with numbers that recurs at the edges of so many pages, whatever its numbers, is a running line.
RECURS = 5
#: Two shapes for one: read -> written.
PAIRS = (("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"))

_CONFUSED: dict[str, set[str]] = {}
_SKELETON: dict[int, str] = {}
for _family in SHAPES:
    for _c in _family:
        _CONFUSED.setdefault(_c, set()).update(set(_family) - {_c})
        # letters that are confused, directly or in steps, have one letter in common
        _SKELETON.setdefault(ord(_c), next((_SKELETON[ord(x)] for x in _family if ord(x) in _SKELETON), _family[0]))
_ARABIC_LETTERS, _PERSIAN_LETTERS, _LATIN_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهويةىأإآءئؤ", "پچژگکی", "abcdefghijklmnopqrstuvwxyzéèàçğışöü"

_STRIP = ".,،؛;:()[]{}«»\"؟?%'’…-–—*/=+<>"
_CLEAN = re.compile(r"^(?:[a-z]+|[ء-غف-يپچژگکی]+)$")
_LOOKS = str.maketrans("АВЕКМНОРСТУХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧονی ک ہ".replace(" ", ""), "ABEKMHOPCTYXaeopcyxiABEZHIKMNOPTYXovيكه")
_UNSEEN = re.compile(r"[​-‏⁠﻿­ً-ْٰـ]")
_IS_ARABIC = re.compile("[ء-يپچژگکی]")
_IS_LATIN = re.compile("[A-Za-z]")
_MARKED = re.compile("[" + re.escape(MARKS) + "]")
_MARK_IN_WORD = re.compile(rf"[^\W\d_][{re.escape(MARKS)}]+[^\W\d_]|^[{re.escape(MARKS)}][^\W\d_]|[^\W\d_][|~^\\°]$")
_MAY_BE_LETTER = re.compile("[" + "".join(DIGITS) + "]")
_DIGIT_IN_WORD = re.compile(rf"^[a-zéèàçğışöü](?=[^\W_]*\d)(?:[a-zéèàçğışöü]|[{''.join(DIGITS)}])*[a-zéèàçğışöü]$")


def _folded(w: str) -> str:
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", w)).translate(_LOOKS).strip(_STRIP).lower()


def word_of(chunk: str) -> str:
    """The word of a run without blanks: no outer punctuation, one form, lower case; empty if it has no letters, or digits."""
    w = chunk.strip(_STRIP)
    if not _CLEAN.match(w):
        w = _folded(w)
        if not any(c.isalpha() for c in w) or any(c.isdigit() for c in w):
            return ""
    return w


def digit_word(chunk: str) -> str:
    """The word of a run of Latin letters with digits read for letters inside, fewer than half; else empty."""
    w = _folded(chunk) if _MAY_BE_LETTER.search(chunk) else ""
    # each 1 has two readings: more than six of them are no word
    return w if _DIGIT_IN_WORD.match(w) and 2 * sum(c.isdigit() for c in w) < len(w) and w.count("1") <= 6 else ""


_DIGITS = r"[\d٠-٩۰-۹]"
_YEAR = rf"{_DIGITS}{{4}}"
_ISSUE = (
    rf"(?:مجلد\s*\(?{_DIGITS}+\)?\s*عدد\s*\(?{_DIGITS}+\)?\s*{_YEAR}"
    rf"|[،,]\s*المجلد\s*{_DIGITS}+\s*[،,]\s*العدد\s*{_DIGITS}+\s*[،,]\s*{_YEAR}"
    rf"|,\s*Vol\.?\s*{_DIGITS}+\s*,\s*(?:Issue|No\.?)\s*{_DIGITS}+\s*\(?{_YEAR}\)?"
    rf"|{_YEAR}\s*;\s*{_DIGITS}+\s*\({_DIGITS}+\))"
)
_NUMBER = rf"(?:{_DIGITS}{{1,4}})"
#: A running line, with the page number that may stand in it.
HEADER = re.compile(
    rf"(?P<no>{_NUMBER}\s{{2,}})?(?:(?=.*\bI\s?S\s?S\s?N\b).{{8,90}}?|[^.]{{3,70}}?\s*{_ISSUE}|(?P<short>.{{6,90}}?)(?:\.\.\.|…))(?P<no2>\s{{2,}}{_NUMBER})?"
)
_MAY_HEAD = ("...", "…", "ISSN", "مجلد", "Vol", ";")
#: A page number alone on its line.
PAGE_NUMBER = re.compile(
    rf"[-–—~]\s*{_NUMBER}\s*[-–—~]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)|(?:ص|صفحة|صفحه|p|pp|page|sayfa|s)\.?\s*{_NUMBER}(?:\s*(?:of|/|من|sur)\s*{_NUMBER})?"
    rf"|{_NUMBER}\s*\|\s*(?:صفحة|صفحه|page|sayfa)|(?:صفحة|page)\s*\|\s*{_NUMBER}|{_NUMBER}\s*/\s*{_NUMBER}|(?P<bare>{_NUMBER})",
    re.I,
)
_HAS_DIGIT = re.compile(_DIGITS)
_CAPTION = re.compile(r"\s*(?:(?:ال)?جدول|table|tableau|tablo|شکل|(?:ال)?شكل)\b", re.I)
_WIDE = re.compile("[　！-￮  - ]")
_CUT = re.compile(r"[-¬–‐‑­][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_TAIL, _HEAD = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")


def _is_table(lines: list[str], at: int) -> bool:
    """Whether a bare number belongs to a column of numbers."""
    near = [lines[k].strip() for k in (at - 1, at + 1) if 0 <= k < len(lines)]
    return any(re.fullmatch(r"[\d٠-٩۰-۹.,٫%]+", x) for x in near) or (at > 0 and bool(_CAPTION.match(lines[at - 1])))


_NUMBERS = re.compile(rf"{_DIGITS}+(?:[.,٫٬/]{_DIGITS}+)*")


def edge_lines(page: str) -> dict[str, str]:
    """The first and last two lines of a page that may be running lines, by their form with a sign for each of two or more numbers."""
    lines = [x for line in page.split("\n") if (x := line.strip())]
    some = {_UNSEEN.sub("", x) for x in (*lines[:2], *lines[-2:]) if 8 <= len(x) <= 120 and x[-1] not in ".؟?!" and _HAS_DIGIT.search(x)}
    return {key: x for x in sorted(some) if (key := _NUMBERS.sub("#", x)).count("#") >= 2 and not PAGE_NUMBER.fullmatch(x)}


def running_lines(page: str, recurs: Callable[[str, str], bool] = lambda key, line: False) -> tuple[str, bool, bool]:
    """The page without running lines, whether it had a header, whether a page number; ``recurs`` tells of an edge line whether many pages have it."""
    plain = unicodedata.normalize("NFKC", page) if _WIDE.search(page) else page
    lines = plain.split("\n")
    header = number = False
    kept = []
    running = {k for k, x in edge_lines(plain).items() if recurs(k, x)}
    for at, line in enumerate(lines):
        text = line.strip()
        if len(text) <= 24 and _HAS_DIGIT.search(text):
            text = _UNSEEN.sub("", text)
            m = PAGE_NUMBER.fullmatch(text)
            bare = m and m.group("bare")
            if m and not (bare and (_is_table(lines, at) or (len(bare) == 4 and 1900 <= int(bare) <= 2100))):
                number = True
                continue
        if len(text) <= 120 and any(x in text for x in _MAY_HEAD):
            text = _UNSEEN.sub("", text)
            m = HEADER.fullmatch(text)
            short = m and m.group("short")
            if m and not (short and (len(short.split()) < 3 or re.search(r"[.؟!]\s", short.replace("et al.", "")))):
                header = True
                number |= bool(m.group("no") or m.group("no2"))
                continue
        # what neither pattern knows may still recur
        if running and len(text) <= 140 and _NUMBERS.sub("#", _UNSEEN.sub("", text)) in running:
            header = True
            number |= bool(re.match(rf"{_NUMBER}\s{{2,}}", text) or re.search(rf"\s{{2,}}{_NUMBER}$", text))
            continue
        kept.append(line)
    return "\n".join(kept), header, number


_AMONG_ARABIC = re.compile(r"(?<=[ء-يپچژگکی،][ \n])([A-Za-z]{1,8})(?=[ \n][ء-يپچژگکی])")


def _fold(sums: dict[str, dict[str, int]], columns: tuple[list, ...]) -> None:
    known: dict[str, str] = {}
    chunks: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    among: Counter[str] = Counter()
    edges: Counter[str] = Counter()
    for page in (p for column in columns for p in column if p):
        parts = page.split()
        chunks.update(parts)
        pairs.update(pairwise(parts))
        if _IS_LATIN.search(page):
            among.update(_AMONG_ARABIC.findall(page))
        for key, line in edge_lines(page).items():
            edges[f"\2{key}"] += 1
            edges[f"\3{line}"] += 1
    words, bigrams = sums["words"], sums["bigrams"]
    for chunk, n in chunks.items():
        w = known[chunk] = word_of(chunk)
        if w:
            words[w] = words.get(w, 0) + n
            shape = "\1" + w.translate(_SKELETON)
            words[shape] = words.get(shape, 0) + n
    words["\0total"] = words.get("\0total", 0) + sum(chunks.values())
    for (a, b), n in pairs.items():
        x, y = known[a], known[b]
        if x and y:
            key = f"{x} {y}"
            bigrams[key] = bigrams.get(key, 0) + n
    for w, n in among.items():
        key = f"\0{w.lower()}"
        words[key] = words.get(key, 0) + n
    for key, n in edges.items():
        words[key] = words.get(key, 0) + n


def statistics(pages: DataFrame, columns: tuple[str, ...] = ("page1", "page2"), word_bits: int = 20, bigram_bits: int = 21) -> dict[str, sketch.Sketch]:
    """Word and bigram counts of all pages; ``word_bits`` and ``bigram_bits`` are the least sizes."""
    return sketch.build(pages.select(*columns), {"words": word_bits, "bigrams": bigram_bits}, _fold)


_ARABIC_WORD = "^[ء-غف-يپچژگکی]{2,}$"


def _count_pairs(sums: dict[str, int], columns: tuple[list, ...]) -> None:
    """Words in Arabic letters, and pairs of words one of which is such a word, with a tab between them."""
    is_one = re.compile(_ARABIC_WORD).match
    chunks: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    for page in (p for column in columns for p in column if p):
        parts = page.split()
        chunks.update(parts)
        pairs.update(pairwise(parts))
    known = {c: word_of(c) for c in chunks}
    ones = {w for w in known.values() if is_one(w)}
    for c, n in chunks.items():
        if (w := known[c]) in ones:
            sums[w] = sums.get(w, 0) + n
    for (c, d), n in pairs.items():
        a, b = known[c], known[d]
        if a and b and (a in ones or b in ones):
            key = f"{a}\t{b}"
            sums[key] = sums.get(key, 0) + n


def whole_words(places: DataFrame, counts: DataFrame) -> DataFrame:
    """(before, after, word): the word that stands between two words far more than all others do; no row where none does.

    ``counts`` has (a, b, n) of pairs of words, and of single words with no b. A
    place meets the words seen on its rarer side first, of which the other side
    keeps some.
    """
    ahead = counts.filter(F.col("b").rlike(_ARABIC_WORD)).select(F.col("a").alias("before"), F.col("b").alias("word"), "n")
    behind = counts.filter(F.col("b").isNotNull() & F.col("a").rlike(_ARABIC_WORD)).select(F.col("a").alias("word"), F.col("b").alias("after"), F.col("n").alias("m"))
    words = counts.filter("b is null").select(F.col("a").alias("word"), F.col("n").alias("c"))
    sized = places.select("before", "after").distinct().join(ahead.groupBy("before").agg(F.count("*").alias("_f")), "before").join(behind.groupBy("after").agg(F.count("*").alias("_p")), "after")
    sized = cut(sized.select("before", "after", (F.col("_f") <= F.col("_p")).alias("_left")))
    met = sized.filter("_left").drop("_left").join(ahead, "before").join(behind, ["after", "word"])
    met = met.unionByName(sized.filter("not _left").drop("_left").join(behind, "after").join(ahead, ["before", "word"]))
    # whole numbers: their sum doesn't depend on its order
    share = F.round(F.col("n") * F.col("m") / F.col("c") * 1e9).cast("bigint").alias("share")
    best = met.join(words, "word").select("before", "after", "word", share).groupBy("before", "after").agg(F.max(F.struct("share", "word")).alias("best"), F.sum("share").alias("all"))
    return best.filter(F.col("best.share") >= SURE * F.col("all")).select("before", "after", "best.word")


class Corrector:
    """Noisy-channel correction of the words of lines."""

    def __init__(self, words: sketch.Sketch, bigrams: sketch.Sketch, ratio: float = 8.0) -> None:
        self.words, self.bigrams, self.ratio = words, bigrams, ratio
        self.total = max(words.count("\0total"), 1)
        self.verdicts: dict[str, tuple[str, list[tuple[str, float]]] | None] = {}
        self.gibberish: dict[str, bool] = {}

    def count(self, word: str) -> int:
        return self.words.count(word)

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Words that may have been read as ``word``, with the channel's log-probability; the word itself first."""
        clean = len(word) * math.log(1 - MISREAD)
        out = [(word, clean if not _MARKED.search(word) else -50.0)]
        own = self.count(word)
        letters = _LATIN_LETTERS if not _IS_ARABIC.search(word) else _PERSIAN_LETTERS + _ARABIC_LETTERS if re.search("[پچژگ]", word) else _ARABIC_LETTERS

        def variants(w: str) -> list[tuple[str, float]]:
            found = []
            for i, c in enumerate(w):
                if c in MARKS:
                    found += [(w[:i] + t + w[i + 1 :], math.log(AS_MARK)) for t in letters]
                else:
                    family = _CONFUSED.get(c, ())
                    found += [(w[:i] + t + w[i + 1 :], math.log(MISREAD / len(family))) for t in family]
            for read, written in PAIRS:
                at = w.find(read)
                while at >= 0:
                    found.append((w[:at] + written + w[at + len(read) :], math.log(MISREAD / 4)))
                    at = w.find(read, at + 1)
            return found

        need = max(4.0, self.ratio * own)
        marked = _MARKED.search(word)
        if not marked and self.count("\1" + word.translate(_SKELETON)) < own + need:
            # no frequent word has these shapes; one shape for two is left
            some = [(word[:at] + written + word[at + len(read) :], math.log(MISREAD / 4)) for read, written in PAIRS for at in range(len(word)) if word.startswith(read, at)]
            return out + [(t, clean + p) for t, p in some if self.count(t) >= need]
        first = variants(word)
        kept = [(t, clean + p) for t, p in first if self.count(t) >= need]
        if not kept and len(word) >= 5 and (not marked or len(_MARKED.findall(word)) > 1):
            # two letters misread in one word
            kept = [(t, clean + p + p2) for w, p in first for t, p2 in variants(w) if t != word and self.count(t) >= need * 4]
        best = {}
        for t, p in kept:
            best[t] = max(p, best.get(t, -1e9))
        # all of them: only the words around tell which one it is
        return out + sorted(best.items(), key=lambda x: -x[1])

    def digit_candidates(self, word: str) -> list[tuple[str, float]]:
        """The same for a word with digits in the place of letters, all of which are replaced."""
        clean = len(word) * math.log(1 - MISREAD)
        # a short run may be a sign of its own: there the words around decide
        out = [(word, -50.0 if len(word) > 3 else clean)]
        read = [("", 0.0)]
        for c in word:
            letters = DIGITS.get(c, c)
            cost = math.log(MISREAD / len(letters)) if c in DIGITS else 0.0
            read = [(w + t, p + cost) for w, p in read for t in letters]
        kept = [(t, clean + p) for t, p in read if self.count(t) >= 4]
        if not kept:
            # a letter is misread besides
            best: dict[str, float] = {}
            for w, p in read:
                for t, p2 in self.candidates(w)[1:]:
                    best[t] = max(p + p2, best.get(t, -1e9))
            kept = [(t, p) for t, p in best.items() if self.count(t) >= 16]
        return out + kept

    def suspect(self, chunk: str) -> tuple[str, list[tuple[str, float]]] | None:
        """(word, candidates) of a run that may be misread; None for any other."""
        known = self.verdicts.get(chunk, 0)
        if known == 0:
            if len(self.verdicts) > 600_000:
                self.verdicts.clear()
            known = None
            w = word_of(chunk)
            if len(w) >= 2:
                if len(w) >= 3 and "-" not in w and "'" not in w:
                    options = self.candidates(w)
                    if len(options) > 1:
                        known = (w, options)
                if known is None and _MARK_IN_WORD.search(w):
                    known = (w, [])
                if known is None and _IS_LATIN.match(w) and len(w) <= 8 and self.is_gibberish(w):
                    known = (w, [])
            elif not w and (w := digit_word(chunk)):
                options = self.digit_candidates(w)
                if len(options) > 1:
                    known = (w, options)
            self.verdicts[chunk] = known
        return known  # type: ignore[return-value]

    def is_gibberish(self, word: str) -> bool:
        """A run of Latin letters that occurs among Arabic words for the most part."""
        known = self.gibberish.get(word)
        if known is None:
            known = self.gibberish[word] = 2 * self.words.count(f"\0{word}") >= self.count(word) > 0 and self.words.count(f"\0{word}") > 0
        return known

    def recurs(self, key: str, line: str) -> bool:
        """Whether an edge line recurs on many pages, most of them with other numbers."""
        n = self.count(f"\2{key}")
        return n >= RECURS and 2 * self.count(f"\3{line}") <= n

    def _bigram(self, a: str, b: str) -> float:
        # without the occurrence at hand: a misread word must not be its own evidence
        ca, cb = max(self.count(a) - 1, 0) if a else 0, max(self.count(b) - 1, 0)
        both = max(self.bigrams.count(f"{a} {b}") - 1, 0) if ca else 0
        return math.log(0.7 * both / (max(ca, both) + 1) + 0.3 * (cb + 0.5) / self.total)

    def decode(self, lattice: list[list[tuple[str, float]]]) -> list[str]:
        """The likeliest words: Viterbi over the candidates of each place."""
        best: list[tuple[float, list[str]]] = [(p + self._bigram("", w), [w]) for w, p in lattice[0]]
        for options in lattice[1:]:
            best = [max(((s + p + self._bigram(path[-1], w), [*path, w]) for s, path in best), key=lambda x: x[0]) for w, p in options]
        return max(best, key=lambda x: x[0])[1]

    def correct(self, chunks: list[str], first_only: bool = False, gaps: list[tuple] | None = None) -> dict[int, str]:
        """place -> correction, for the words found misread; what can't be restored maps to itself.

        ``first_only``: stop at the first one, where only its being there is asked for.
        ``gaps`` gets (before, after, level, form, read) of each whole word read in other letters, which maps to a tab
        until its word is known; ``level`` gaps stand right before it.
        """
        get, suspect = self.verdicts.get, self.suspect
        hits = [(k, v) for k, c in enumerate(chunks) if (v := get(c, 0)) is not None]
        out: dict[int, str] = {}
        last, gap, level = -1, -1, 0
        for k, v in hits:
            if v == 0 and (v := suspect(chunks[k])) is None or k <= last:
                continue
            if first_only and out:
                break
            word, options = v
            if not options:
                near = "".join(chunks[max(0, k - 1) : k] + chunks[k + 1 : k + 2])
                if _MARKED.search(word) or _IS_ARABIC.search(near):
                    out[k] = chunks[k]
                    if gaps is not None and not first_only and _IS_LATIN.match(word) and 0 < k < len(chunks) - 1:
                        before, after = word_of(chunks[k - 1] if gap == k - 1 else out.get(k - 1, chunks[k - 1])), word_of(chunks[k + 1])
                        if before and after:
                            level = level + 1 if gap == k - 1 else 0
                            gaps.append((before, after, level, chunks[k].lower().replace(word, "\t"), chunks[k]))
                            gap, out[k] = k, "\t"
                continue
            # the run of suspects with a known word on either side
            run, lattice = [k], [options]
            while run[-1] + 1 < len(chunks) and (v := suspect(chunks[run[-1] + 1])) is not None and v[1]:
                run.append(run[-1] + 1)
                lattice.append(v[1])
            last = run[-1]
            before, after = (word_of(chunks[k - 1]) if k else ""), (word_of(chunks[last + 1]) if last + 1 < len(chunks) else "")
            lattice = [[(before, 0.0)]] * bool(before) + lattice + [[(after, 0.0)]] * bool(after)
            for j, w in zip(run, self.decode(lattice)[bool(before) :]):
                read = suspect(chunks[j])[0]  # type: ignore[index]
                if w != read:
                    plain = unicodedata.normalize("NFKC", chunks[j])
                    out[j] = plain.replace(read, w) if read in plain else w
        return out

    def is_cut(self, left: str, right: str) -> bool:
        """Whether two parts at a line end are one word cut in two, no compound."""
        a, b = word_of(left), word_of(right)
        if not a or not b:
            return False
        whole, compound = self.count(a + b), self.count(f"{a}-{b}")
        if whole or compound:
            return whole >= compound
        if a in ("al", "el") or (left[:1].isupper() and right[:1].isupper()):
            return False
        # unknown both ways: two known words are rather a compound
        return not (min(self.count(a), self.count(b)) >= 50 and len(a) > 2 and len(b) > 2)

    def join_cuts(self, text: str) -> tuple[str, bool]:
        """``text`` with words cut at line ends in one piece, and whether there were any."""
        out: list[str] = []
        at, cut = 0, False
        for m in _CUT.finditer(text):
            left = _TAIL.search(text, max(at, m.start() - 40), m.start())
            right = _HEAD.match(text, m.end())
            if left and right:
                one = self.is_cut(left.group(), right.group())
                cut |= one
                out += [text[at : m.start()], "" if one else m.group()[0]]
                at = m.end()
        return ("".join([*out, text[at:]]) if out else text), cut

    def repair(self, page: str, with_text: bool = True, gaps: list[tuple] | None = None) -> tuple[str | None, list[str]]:
        """(continuous text, kinds of damage) of a page; the text only if asked for, with a tab for each of ``gaps``."""
        text, header, number = running_lines(page, self.recurs)
        text, cut = self.join_cuts(text)
        lines = text.split("\n")
        parts = [line.split() for line in lines]
        # the page as one row of words: a line's first and last words have neighbours too
        fixed = self.correct([c for some in parts for c in some], first_only=not with_text, gaps=gaps)
        paragraphs: list[list[str]] = [[]]
        if with_text:
            width = max(map(len, lines), default=0)
            at = 0
            for line, chunks in zip(lines, parts):
                if not chunks:
                    paragraphs.append([])
                    continue
                paragraphs[-1].append(" ".join(fixed.get(at + k, c) for k, c in enumerate(chunks)))
                at += len(chunks)
                if line.rstrip().endswith((".", "؟", "?", "!")) and (len(line) < 0.8 * width or len(lines) < 3):
                    paragraphs.append([])
        kinds = [k for k, there in (("hyphen", cut), ("misread", bool(fixed)), ("header", header), ("pageno", number)) if there]
        return ("\n\n".join(" ".join(p) for p in paragraphs if p) if with_text else None), kinds


_CORRECTORS: dict[str, Corrector] = {}


def _corrector(name: str, packed: Callable[[], dict[str, tuple[int, bytes]]]) -> Corrector:
    """The corrector of one run, one for each worker process: what it learned about words serves its later tasks."""
    if name not in _CORRECTORS:
        _CORRECTORS.clear()
        sketches = {k: sketch.Sketch.unpacked(*x) for k, x in packed().items()}
        _CORRECTORS[name] = Corrector(sketches["words"], sketches["bigrams"])
    return _CORRECTORS[name]


_GAP = "array<struct<before: string, after: string, level: int, form: string, read: string>>"
_GAP_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("level", pa.int32()), ("form", pa.string()), ("read", pa.string())]))


def repair_pages(pages: DataFrame, key: str = "row_no", columns: tuple[str, ...] = ("page1", "page2"), with_text: bool = True, stats: dict[str, sketch.Sketch] | None = None) -> DataFrame:
    """(key, page_no, kinds, text) of every page of ``pages``; ``text`` only if asked for."""
    stats = stats or statistics(pages, columns)
    shared = pages.sparkSession.sparkContext.broadcast({k: s.packed() for k, s in stats.items()})
    name = uuid.uuid4().hex

    def make() -> Callable[..., tuple]:
        corrector = _corrector(name, lambda: shared.value)

        def each(keys: list, *texts: list) -> tuple:
            out_keys, numbers, kinds, repaired, gaps = [], [], [], [], []
            for no, column in enumerate(texts, 1):
                for k, page in zip(keys, column):
                    own: list[tuple] = []
                    text, some = (page, []) if not page else corrector.repair(page, with_text, own)
                    out_keys.append(k)
                    numbers.append(no)
                    kinds.append(some)
                    repaired.append(text)
                    gaps.append([dict(zip(("before", "after", "level", "form", "read"), g)) for g in own])
            return (out_keys, numbers, kinds, repaired, gaps) if with_text else (out_keys, numbers, kinds)

        return each

    schema = f"`{key}` bigint, page_no int, kinds array<string>" + f", text string, _gaps {_GAP}" * with_text
    arrow = [(key, pa.int64()), ("page_no", pa.int32()), ("kinds", pa.list_(pa.string()))] + [("text", pa.string()), ("_gaps", _GAP_ARROW)] * with_text
    rows = pages.select(F.col(key).cast("bigint").alias(key), *columns)
    found = map_rows(rows, make, schema, pa.schema(arrow))
    return _filled(found, pages.select(*columns)) if with_text else found


def _filled(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found`` without ``_gaps``, with their words in the place of the tabs of ``text``; repeated rows stay."""
    found = stored(found.withColumn("_id", F.monotonically_increasing_id()))
    some = found.filter(F.size("_gaps") > 0)
    gaps = cut(some.select("_id", F.posexplode("_gaps").alias("pos", "g")).select("_id", "pos", "g.*"))
    most = gaps.agg(F.max("level")).first()[0]
    out = found.drop("_gaps", "_id")
    if most is None:
        return out
    key, is_pair = F.col("key"), F.col("key").contains("\t")
    counts = stored(partial_counts(pages, _count_pairs).select(F.when(is_pair, F.substring_index("key", "\t", 1)).otherwise(key).alias("a"), F.when(is_pair, F.substring_index("key", "\t", -1)).alias("b"), "n"))
    told = None
    for level in range(most + 1):
        here = gaps.filter(F.col("level") == level)
        if told is not None:
            # what stands before is the word told for the gap there, if there is one
            last = told.filter((F.col("level") == level - 1) & F.col("form").contains("\t")).select("_id", (F.col("pos") + 1).alias("pos"), F.col("word").alias("_last"))
            here = here.join(last, ["_id", "pos"], "left").withColumn("before", F.coalesce("_last", "before")).drop("_last")
            here = cut(here)
        here = cut(here.join(whole_words(here, counts), ["before", "after"], "left"))
        told = here if told is None else told.unionByName(here)
    fill = F.when(F.col("word").isNull(), F.col("read")).otherwise(F.replace("form", F.lit("\t"), F.col("word")))
    fills = told.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", fill.alias("fill")))).alias("fills"))
    text = F.array_join(F.zip_with(F.split("text", "\t"), "fills", lambda t, f: F.concat(t, F.coalesce(f["fill"], F.lit("")))), "")
    filled = some.join(fills, "_id").withColumn("text", text).select(*out.columns)
    return found.filter(F.size("_gaps") == 0).select(*out.columns).unionByName(filled)
