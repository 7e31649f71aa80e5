"""Keyword-stuffed and link-list pages, by rank-frequency curves against prose.

The words of a page, ranked by frequency with a SQL window, give a curve: a straight line through
log frequency over log rank has a slope and a residual.  The common words of each language are
learned from all distinct texts, so no word list is built in; the page's language is the one whose
common words it has most of, and its divergence is the relative entropy of its shares of common words against
that language's prose.  A page is flagged if slope, residual or divergence is extreme against prose
of the same language and of comparable length.  Of a flagged page the pieces (sentences and lines) are
then checked one by one: it is reported if most of its text is keywords, links or tags.

What prose looks like is taken from distinct pages that have at least half the share of common words
that the pages of the language richest in them have, so that stuffed pages and copies, however many, do not
set the norm.  A page that nothing says what is normal for is checked like a flagged one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakite.plans.stage import staged

COMMON_WORDS = 100  # of a language, in bands of falling frequency
BANDS = (1, 2, 4, 8, 15, 40, 100)  # last rank of each band
VOCABULARY = 600  # words of a language that tell a page of it from one of an unknown language
LEAST_PAGES = 3.0  # pages that a common word must be on, each page counted the less the more it repeats the word
LEAST_WORDS = 12
LEAST_STRUNG = 4  # links, tags, dotted words, repeats and further items, for a page of fewer words
EXTREME = 2.5  # robust deviations
MOSTLY = 0.6
PIECE_WORDS = 24
REPEATED = 4
KNOWN = 0.25  # share of a page's words in a language's vocabulary
SENTENCE = 0.35  # of the language's usual share of common words
SENTENCE_WORDS = 40
OFTEN = 0.08
STUFFED_WORDS, STUFFED_TIMES = 4, 8.0  # a common word that is on a page so often, and so many times its share of prose, is a keyword of that page
_CJ = "ぁ-ゟ㐀-䶿一-鿿豈-﫿"
_KATA = "゠-ヿ"
_WORD = re.compile(f"[{_CJ}]|[{_KATA}]+|[^\\W\\d_{_CJ}{_KATA}]{{2,}}")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def structure_regexes() -> dict[str, re.Pattern]:
    return {
        "dotted": re.compile(r"(?<![\w.])[^\W_](?:\.[^\W_ ]| (?=[^\W_]\.)){2,}\.?|(?<![\w.])[^\W_](?:\.[\w ]){2,}\.?"),
        "dotted_word": re.compile(r"(?<![\w.])[^\W\d_](?:\.[^\W\d_]){3,}(?!\w)"),
        "items": re.compile(r"[,;|•·・、，]|\s[/>–—-]\s"),
        "lines": re.compile(r"[\r\n\x0b\x0c\x85  ]+"),
        "sentences": re.compile(r"(?<=[.!?…؟।])\s+|(?<=[。！？])"),
        "marker": re.compile(r"^\s*(?:[>|*+•-]+\s*|\d+[.)]\s+|\[\d+\]\s*)+"),
        "url": re.compile(r"(?:https?://|www\.)[^\s<>\"'\])|]+|(?<!\S)(?:[\w-]+\.)+[a-z]{2,}(?:/[^\s<>\"'\])|]*|(?=\s|$))"),
        "tag": re.compile(r"</?(?:a\s|[A-Za-z]{2,})[^<>]*>|\[/?url[^\]]*\]|(?<!\w)#\w[\w-]*"),
        "number": re.compile(r"\d+(?:[.,:]\d+)*"),
        "cjk": re.compile(f"[{_CJ}]"),
        "code": re.compile(r"\w=\S|\w\(|[{}]\s*$|\);\s*$|^\s*(?:def|for|if|return|import|class|while)\b|->|==|&&|0x[0-9a-f]|\b(?:INFO|WARN|DEBUG|ERROR|TRACE)\b"),
    }


def word_hash(word: bytes) -> int:
    """32 bits of a word, signed; equal in every process."""
    import xxhash

    return xxhash.xxh32_intdigest(word) - (1 << 31)


_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_WIDER = re.compile(f"[{_CJ}{_KATA}]")
_END = re.compile(r"[.!?…؟।](?=\s|$)|[。！？]")
_LATIN = re.compile(r"[^\W\d_]{2,}")


def page_counts(text: str) -> Counter:
    """The words of a page, as UTF-8, with how often each is there."""
    text = text.lower()
    if text.isascii():
        return Counter([w for w in text.encode().translate(_LETTERS).split() if len(w) > 1])
    text = _HIDDEN.sub("", text)
    c = Counter((_WORD if _WIDER.search(text) else _LATIN).findall(text))
    return Counter({w.encode("utf-8", "surrogatepass"): n for w, n in c.items()})


class Lexicon:
    """The learned words of all languages, by hash: at most 677 languages of VOCABULARY words."""

    def __init__(self, rows: list[tuple[str, int, int, float]] = (), usual: dict[str, float] | None = None):
        """`rows`: (language, hash, rank from 1, share of the words of a page); `usual`: the share of common words that prose of a language has."""
        self.langs = sorted({lang for lang, _, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        a = np.array([(h, at[lang], r) for lang, h, r, _ in rows], np.int64).reshape(-1, 3)
        order = np.lexsort((a[:, 1], a[:, 0]))
        self.hashes, self.lang, self.rank = a[order].T
        self.rate = np.array([r[3] for r in rows], np.float64)[order]
        self.words, self.first = np.unique(self.hashes, return_index=True)
        self.first = np.append(self.first, len(self.hashes))
        self.usual = dict(usual or {})
        self.rows = [(at[lang], h, r, rate) for lang, h, r, rate in rows]
        self._index()

    def _index(self) -> None:
        self._of: dict[int, list[tuple[int, int, float]]] = {}
        for lang, h, r, rate in self.rows:
            self._of.setdefault(h, []).append((lang, r, rate))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_of"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def told(self, counts: dict[str, int]) -> tuple[str | None, frozenset]:
        """The language of a page of these words, if it is known, and those of its words that are common in it."""
        total, vocabulary, found = sum(counts.values()), Counter(), {}
        for w, n in counts.items():
            for lang, r, rate in self._of.get(word_hash(w.encode("utf-8", "surrogatepass")), ()):
                vocabulary[lang] += n
                if r <= COMMON_WORDS and (n < STUFFED_WORDS or n <= STUFFED_TIMES * rate * total):
                    found.setdefault(lang, set()).add(w)
        if not vocabulary:
            return None, frozenset()
        best = max(vocabulary, key=lambda i: (sum(counts[w] for w in found.get(i, ())), vocabulary[i], -i))
        if vocabulary[best] < KNOWN * total or self.langs[best] not in self.usual:
            return None, frozenset()
        return self.langs[best], frozenset(found.get(best, ()))

    def profiles(self, hashes: np.ndarray, counts: np.ndarray, page: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
        """Per page: the index of the language of most common words (-1 for none), and its words in each band of that language, without those it is stuffed with."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        hit = np.flatnonzero(self.words[at] == hashes) if len(self.words) else np.zeros(0, np.int64)
        lo, hi = self.first[at[hit]], self.first[at[hit] + 1]
        n = hi - lo
        row = np.repeat(hit, n)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        band = np.searchsorted(BANDS, self.rank[entry])
        total = np.bincount(page, weights=counts, minlength=pages)
        stuffed = (counts[row] >= STUFFED_WORDS) & (counts[row] > STUFFED_TIMES * self.rate[entry] * total[page[row]])
        row, entry, band = (v[(band < len(BANDS)) & ~stuffed] for v in (row, entry, band))
        k = max(len(self.langs), 1)
        cover = np.bincount(page[row] * k + self.lang[entry], weights=counts[row], minlength=pages * k).reshape(pages, k)
        best = np.where(cover.max(1) > 0, cover.argmax(1), -1)
        mine = self.lang[entry] == best[page[row]]
        shares = np.bincount(page[row][mine] * len(BANDS) + band[mine], weights=counts[row][mine], minlength=pages * len(BANDS)).reshape(pages, -1)
        return best, shares


class Structure:
    """How much of a text is sentences, data (logs, tables, code) and strings of keywords, links and tags."""

    def __init__(self, lexicon: Lexicon | None = None):
        self.r, self.lexicon = structure_regexes(), lexicon or Lexicon()

    def clean(self, text: str) -> str:
        """Without invisible characters and dots between letters."""
        text = _HIDDEN.sub("", text)
        return self.r["dotted"].sub(lambda m: m.group().replace(".", ""), text) if "." in text else text

    def kind(self, s: str, words: list[str], ended: bool, common: frozenset, least: float | None) -> str:
        """`sentence`, `data` or `string` of a piece whose words outside links and tags are `words`; `least`: the share of common words of a sentence, None if the language is unknown."""
        r = self.r
        links = len(r["url"].findall(s)) if "." in s else 0
        bare = r["url"].sub(" ", s) if links else s
        tags = len(r["tag"].findall(bare)) if "<" in s or "#" in s or "[" in s else 0
        n, marks = len(words), links + tags
        if not n:
            return "string" if marks else "data"
        kinds, apart = len(set(words)), len(r["items"].findall(bare))
        if least is not None:
            hits = len({w for w in words if w in common})
            if marks and 6 * marks >= n and hits < 4:
                return "string"
            if hits >= max(2.0, least * n * (2 if 4 * apart >= n else 1)) or n <= 3 and hits and ended:
                return "sentence"
            if ended and n >= 6 and hits >= max(2.0, least * n / 2) and kinds >= 0.75 * n and 4 * apart < n:
                return "sentence"
        else:
            if marks and 6 * marks >= n:
                return "string"
            if n >= 4 and ended and kinds >= (0.5 if n > 15 else 0.7) * n and apart <= n / 4:
                return "sentence"
        if marks:
            return "string"
        numbers = len(r["number"].findall(bare))
        if numbers >= 2 and numbers >= n or r["code"].search(bare):
            return "data"
        return "string"

    def pieces(self, text: str):
        """(piece, its words outside links and tags, whether it ends like a sentence): sentences and lines, long ones cut."""
        r = self.r
        for line in r["lines"].split(text):
            for s in r["sentences"].split(r["marker"].sub("", line)):
                s = s.strip()
                if not s:
                    continue
                bare = r["url"].sub(" ", s) if "." in s else s
                bare = r["tag"].sub(" ", bare) if "<" in bare or "#" in bare or "[" in bare else bare
                words = _WORD.findall(bare.lower())
                ended = bare.rstrip()[-1:] in tuple(".!?…:。！？؟।")
                if len(words) <= 2 * PIECE_WORDS or r["cjk"].search(bare):
                    yield s, words, ended
                    continue
                parts = s.split(" ")
                for i in range(0, len(parts), PIECE_WORDS):
                    p = " ".join(parts[i : i + PIECE_WORDS])
                    bare = r["tag"].sub(" ", r["url"].sub(" ", p))
                    yield p, _WORD.findall(bare.lower()), ended

    def strung(self, text: str) -> int:
        """Links, tags, dotted words, words that repeat another, and items after the first, in lines or between separators: what sets a short string of keywords apart from a short remark."""
        r = self.r
        n = len(r["dotted_word"].findall(_HIDDEN.sub("", text)))
        items, words = 0, []
        for line in r["lines"].split(self.clean(text)):
            n += len(r["url"].findall(line))
            bare = r["url"].sub(" ", line)
            n += len(r["tag"].findall(bare))
            bare = r["tag"].sub(" ", bare).strip()
            found = _WORD.findall(bare.lower())
            words += found
            if bare[-1:] not in tuple(".!?…。！？"):
                items += sum(bool(_WORD.search(i.lower())) for i in r["items"].split(bare))
        return n + max(items - 1, 0) + len(words) - len(set(words))

    def shares(self, text: str) -> tuple[float, float, int]:
        """(share of strings, share of data) of the characters that are in any piece, and the number of words, letters joined by dots being one.

        A piece whose words a page has had REPEATED times before is no sentence.
        """
        text = self.clean(text)
        size, seen = {"sentence": 0, "data": 0, "string": 0}, Counter()
        counts = Counter(_WORD.findall(text.lower()))
        lang, common = self.lexicon.told(counts)
        least = None if lang is None else SENTENCE * self.lexicon.usual[lang]
        for s, words, ended in self.pieces(text):
            kind = self.kind(s, words, ended, common, least)
            key = tuple(words) + tuple(self.r["number"].findall(s))
            if kind == "sentence" and len(words) >= 4:
                seen[key] += 1
                if seen[key] > REPEATED:
                    kind = "string"
            size[kind] += len(s)
        total = sum(size.values()) or 1
        return size["string"] / total, size["data"] / total, sum(counts.values())


_FAR = ("far_slope", "far_residual", "far_divergence")
_SPECTRUM = "doc_id bigint, tag string, text_key bigint, words bigint, ends bigint, hashes array<int>, counts array<int>"
_POINTS = "doc_id bigint, n int, v int, lang string, " + ", ".join(f"b{i} int" for i in range(len(BANDS)))


def language(lang: Column) -> Column:
    """The two-letter language of an oddly written tag, else `und`."""
    two = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(F.coalesce(two, F.lit("")) == "", "und").otherwise(two)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(v, np.int32) for v in values]) if values else np.zeros(0, np.int32), kind))


def _count(batches):
    import xxhash

    memory: dict[bytes, int] = {}  # hashes of words met so far
    for b in batches:
        hashes, counts, keys, ends = [], [], [], []
        for text in b.column("text").to_pylist():
            c = page_counts(text)
            h = []
            for w in c:
                if (x := memory.get(w)) is None:
                    if len(memory) > 200_000:
                        memory.clear()
                    x = memory[w] = word_hash(w)
                h.append(x)
            hashes.append(h)
            ends.append(len(_END.findall(text)))
            counts.append(list(c.values()))
            keys.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
        words = pa.array([sum(c) for c in counts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(keys, pa.int64()), words, pa.array(ends, pa.int64()), _lists(hashes, pa.int32()), _lists(counts, pa.int32())], ["doc_id", "tag", "text_key", "words", "ends", "hashes", "counts"])


def spectra(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text_key, words, ends, hashes, counts): the words of every page and its ends of sentences, counted where it is read."""
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), "text", language(F.col("lang")).alias("tag")).mapInArrow(_count, _SPECTRUM)


def learned(counted: DataFrame) -> DataFrame:
    """(lang, hash, rank, rate): the VOCABULARY words on most distinct texts of each language.

    Pages without an end of a sentence for every SENTENCE_WORDS words teach nothing.  A page counts in full for a word that is at most OFTEN of its words, or there twice, else by one over its times there, so
    that keywords repeated over and over weigh little; equal texts count once.  A language is two letters, so there
    are at most 677 of them.  `rate`: the word's share of a page, by the same weights.
    """
    some = counted.where(f"tag <> 'und' AND words > 0 AND ends * {SENTENCE_WORDS} >= words")
    one = some.groupBy("text_key").agg(F.min_by(F.struct("tag", "words", "hashes", "counts"), "doc_id").alias("p")).select("p.*")
    each = one.select("tag", "words", F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select("tag", "words", F.col("w.hashes").alias("hash"), F.col("w.counts").alias("n"))
    weight = F.when(F.col("n") <= F.greatest(F.lit(2.0), OFTEN * F.col("words")), 1.0).otherwise(1.0 / F.col("n"))
    s = each.groupBy("tag", "hash").agg(F.round(F.sum(weight), 6).alias("score"), F.sum(weight * F.least(F.col("n") / F.col("words"), F.lit(OFTEN))).alias("rate")).where(F.col("score") >= LEAST_PAGES)
    r = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "hash"))
    top = s.withColumn("rank", r).where(F.col("rank") <= VOCABULARY)
    pages = some.groupBy("tag", "text_key").count().groupBy("tag").agg(F.count("*").alias("pages"))
    return top.join(F.broadcast(pages), "tag").select(F.col("tag").alias("lang"), "hash", "rank", (F.col("rate") / F.col("pages")).alias("rate"))


def _points(held):
    def run(batches):
        lexicon = held.value
        for b in batches:
            if not b.num_rows:
                continue
            hashes, counts = b.column("hashes"), b.column("counts")
            page = np.repeat(np.arange(b.num_rows), hashes.value_lengths().to_numpy())
            h, n = hashes.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            best, bands = lexicon.profiles(h, n, page, b.num_rows)
            code, v = np.unique((page << 32) | n, return_counts=True)
            row = code >> 32
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            names = pa.array(lexicon.langs, pa.string()).take(pa.array(best[row], pa.int64(), mask=best[row] < 0)) if lexicon.langs else pa.nulls(len(row), pa.string())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(v.astype(np.int32)), names, *[pa.array(np.where(first, bands[row, i], 0).astype(np.int32)) for i in range(len(BANDS))]],
                ["doc_id", "n", "v", "lang", *[f"b{i}" for i in range(len(BANDS))]],
            )

    return run


def curves(counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, lang, words, size_bin, slope, residual, b0...) of every page with LEAST_WORDS words or more.

    The curve: log frequency over log rank, words of one frequency sharing their middle rank; the ranks
    come from a window over each page's frequencies.  `lang` is the language whose common words make up
    most of the page, null if none does; b0... are the page's shares of those words by band.  Rows that repeat a
    doc_id are ranked together.
    """
    held = counted.sparkSession.sparkContext.broadcast(lexicon)
    points = counted.mapInArrow(_points(held), _POINTS)
    last = F.sum("v").over(Window.partitionBy("doc_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = points.withColumn("x", F.log(last - (F.col("v") - 1) / 2.0)).withColumn("y", F.log("n"))
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    sums = {"kinds": v, "words": v.cast("long") * F.col("n"), "sx": v * x, "sy": v * y, "sxx": v * x * x, "sxy": v * x * y, "syy": v * y * y} | {f"b{i}": F.col(f"b{i}") for i in range(len(BANDS))}
    both = ranked.groupBy("doc_id").agg(F.max("lang").alias("lang"), *[F.sum(e).alias(k) for k, e in sums.items()]).where(F.col("words") >= LEAST_WORDS)
    cxx, cxy, cyy = (F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("kinds") for a, b in ("xx", "xy", "yy"))
    slope = F.when(cxx > 1e-12, cxy / F.when(cxx > 1e-12, cxx)).otherwise(0.0)
    left = F.greatest(cyy - slope * cxy, F.lit(0.0))
    return both.select(
        "doc_id", "lang", "words", F.floor(F.log2("words")).cast("int").alias("size_bin"), slope.alias("slope"), F.sqrt(left / F.col("kinds")).alias("residual"),
        *[(F.col(f"b{i}") / F.col("words")).alias(f"b{i}") for i in range(len(BANDS))],
    )


def prose_norms(curve: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """The usual share of common words of prose in each language, and (lang, size_bin, q_b0..., q_slope, q_residual, q_divergence): medians of its bands, quartiles of the rest.

    A page also counts for the lengths beside its own, and for size_bin -1, which stands for all.
    """
    bands = [f"b{i}" for i in range(len(BANDS))]
    share = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    same = [F.round(c, 9).alias(f"_{c}") for c in ("slope", "residual", *bands)]
    one = curve.where("lang IS NOT NULL").select("*", *same, share.alias("share")).dropDuplicates(["lang", "words", *[f"_{c}" for c in ("slope", "residual", *bands)]])
    usual = {r.lang: float(r.usual) for r in one.groupBy("lang").agg(F.percentile_approx("share", 0.9, 1000).alias("usual")).collect()}  # at most 677 rows
    if not usual:
        return usual, None
    least = F.create_map(*[F.lit(v) for lang, u in sorted(usual.items()) for v in (lang, u / 2)])
    prose = one.where(F.col("share") >= least[F.col("lang")]).withColumn("size_bin", F.explode(F.array(*[F.col("size_bin") + i for i in (-1, 0, 1)], F.lit(-1))))
    medians = prose.groupBy("lang", "size_bin").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"q_{c}") for c in bands])
    medians = staged(medians, "medians")
    names = ("slope", "residual", "divergence")
    spread = divergence(prose, medians).groupBy("lang", "size_bin").agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{c}") for c in names])
    return usual, staged(medians.join(spread, ["lang", "size_bin"]), "norms")


def divergence(pages: DataFrame, medians: DataFrame) -> DataFrame:
    """`pages` with `divergence`: the relative entropy of a page's band shares against the median shares of its language and length.  `medians` has at most 677 languages of a few lengths."""
    bands = [f"b{i}" for i in range(len(BANDS))]
    parts = [(F.col(c), F.col(f"q_{c}")) for c in bands]
    parts.append((1 - sum(p for p, _ in parts), 1 - sum(q for _, q in parts)))
    eps = 0.5 / F.col("words")
    terms = [(F.greatest(p, F.lit(0.0)) + eps) * F.log((F.greatest(p, F.lit(0.0)) + eps) / (F.greatest(q, F.lit(0.0)) + eps)) for p, q in parts]
    return pages.join(F.broadcast(medians), ["lang", "size_bin"]).withColumn("divergence", sum(terms))


def far_from_prose(curve: DataFrame, norms: DataFrame) -> DataFrame:
    """(doc_id, far_slope, far_residual, far_divergence): robust deviations of every page from prose of its language and length, or of all lengths where none is known.  Pages of an unknown language are left out."""
    near = curve.join(F.broadcast(norms.select("lang", "size_bin", F.lit(True).alias("_known"))), ["lang", "size_bin"], "left").withColumn("size_bin", F.when(F.col("_known"), F.col("size_bin")).otherwise(-1)).drop("_known")
    far = lambda c: F.abs(F.col(c) - F.col(f"q_{c}")[1]) / F.greatest((F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) / 1.349, F.lit(1e-3))
    return divergence(near, norms).select("doc_id", *[far(c).alias(f"far_{c}") for c in ("slope", "residual", "divergence")])


def _structures(held):
    def run(batches):
        of = Structure(held.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            judged = [of.shares(t) for t in texts]
            strings, words = [j[0] for j in judged], [j[2] for j in judged]
            strung = [of.strung(t) if w < LEAST_WORDS and s >= MOSTLY else 0 for t, w, s in zip(texts, words, strings)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(strings, pa.float64()), pa.array(words, pa.int64()), pa.array(strung, pa.int64())], ["doc_id", "strings", "words", "strung"])

    return run


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(found pages, their deviations from prose)."""
    spark = docs.sparkSession
    counted = staged(spectra(docs), "spectra")
    rows = [tuple(r.values()) for r in learned(counted).toArrow().to_pylist()]
    lexicon = Lexicon(sorted(rows))
    curve = staged(curves(counted, lexicon), "curves")
    usual, norms = prose_norms(curve)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = None
    if norms is not None:
        told = far_from_prose(curve, norms)
        extreme = sum(F.when(F.col(c) > EXTREME, 1).otherwise(0) for c in _FAR) > 0
        texts = texts.join(told.where(~extreme).select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    held = spark.sparkContext.broadcast(Lexicon([(lexicon.langs[i], h, r, p) for i, h, r, p in lexicon.rows], usual))
    each = texts.mapInArrow(_structures(held), "doc_id bigint, strings double, words bigint, strung bigint")
    page = each.groupBy("doc_id").agg(F.max("strings").alias("strings"), F.sum("words").alias("words"), F.max("strung").alias("strung"))
    found = page.where((F.col("strings") >= MOSTLY) & ((F.col("words") >= LEAST_WORDS) | (F.col("strung") >= LEAST_STRUNG))).select("doc_id", "strings")
    return found, told


def found_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, strings) of the pages that are flagged by their curve, or that nothing says what is normal for, and are MOSTLY strings, with LEAST_WORDS words or LEAST_STRUNG things strung together."""
    return _judged(docs)[0]


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, strings, far_slope, far_residual, far_divergence) of keyword-stuffed and link-list pages.

    `docs`: doc_id, text, lang; other columns are ignored.  Null, empty and blank texts and short
    remarks are none.  The language is told from the words; the tag only helps to learn them, so a null, wrong
    or unknown one does no harm.  Rows with a null doc_id are left out; rows that repeat a doc_id are one page.
    The three deviations are null for pages of an unknown language and for those of fewer than LEAST_WORDS words.
    """
    found, told = _judged(docs)
    if told is None:
        return found.select("doc_id", "strings", *[F.lit(None).cast("double").alias(c) for c in _FAR])
    return found.join(told, "doc_id", "left").select("doc_id", "strings", *_FAR)


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents that are mostly keywords, links, menus or tags."""
    from terrakite.plans.stage import table

    return found_pages(table(spark, sf_dir, "documents")).select("doc_id")
