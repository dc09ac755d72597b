"""Evaluation passages in a corpus: an FM-index for each shard of documents, searched for the passages' phrases."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---------------------------------------------------------------- words

#: Bytes of a text as they count: ASCII letters in lower case, digits, and every byte of other scripts; the rest parts words.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(rb"</?[A-Za-z!?][^<>]*>|&#?[A-Za-z0-9]{1,8};")
#: General punctuation, currency signs, Latin-1 signs, dandas; zero-width characters and soft hyphens go without a trace.
_SIGNS = re.compile(rb"\xe2\x80[\x90-\xbf]|\xe2\x80[\x80-\x8a]|\xe2[\x81-\xaf][\x80-\xbf]|\xc2[\xa0-\xac\xae-\xbf]|\xe0\xa5[\xa4\xa5]|\xef\xbc[\x80-\x8f]|\xe3\x80[\x80-\x9f]")
_NOTHING = re.compile(rb"\xe2\x80[\x8b-\x8f]|\xc2\xad|\xef\xbb\xbf|-[ \t]*\r?\n\s*")


#: Runs of UTF-8 that was read as Windows-1252: a lead byte's letter, then the letters and signs of the bytes after it.
_BROKEN = re.compile("(?:[\u00c2-\u00df\u00e0-\u00ef][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,2})+")


_LEADS = ("\u00e0\u00a4", "\u00e0\u00a5", "\u00e2\u201a", "\u00e2\u20ac", "\u00e2\u0080", "\u00e2\u0082", "\u00c2", "\u00c3")


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1", "replace")  # the five bytes that Windows-1252 leaves undefined


def mended(text: str) -> str:
    """``text`` with UTF-8 that was read as Windows-1252 restored; what does not decode stays as it is."""

    def fix(m: re.Match) -> str:
        try:
            return b"".join(_byte(c) for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _BROKEN.sub(fix, text) if any(c in text for c in _LEADS) else text


def word_bytes(text: str) -> bytes:
    """``text`` with its words, and only them, parted by single or more spaces, in UTF-8."""
    b = _MARKUP.sub(b" ", (text if text.isascii() else mended(text)).encode("utf-8", "replace"))
    if b"-\n" in b or b"- \n" in b or b"-\r" in b or not b.isascii():
        b = _SIGNS.sub(b" ", _NOTHING.sub(b"", b))
    return b.translate(_KEEP)


#: Tags of any length; a sign of comparison before a blank or a number is none.
_TAGS = re.compile(r"</?[A-Za-z!?][^<>]*>")


class _Marks(dict):
    """For ``str.translate``: letters, digits and vowel signs stay, the rest goes."""

    def __missing__(self, c: int) -> int | None:
        x = chr(c)
        self[c] = out = c if x.isalnum() or unicodedata.category(x)[0] == "M" else None
        return out


_MARKS = _Marks()


def squashed(text: str) -> str:
    """Only the letters, digits and vowel signs of ``text``, in lower case, without markup: spacing, punctuation and broken words leave no mark."""
    t = _TAGS.sub("", text if text.isascii() else mended(text))
    if "&" in t:
        t = html.unescape(t)
    if t.isascii():
        return re.sub(r"[^a-z0-9]+", "", t.lower())
    return unicodedata.normalize("NFKC", t).lower().translate(_MARKS)


#: ASCII letters in lower case and digits; the separators that ``str.split`` knows part words, the rest goes.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 28 <= b <= 31 else b for b in range(256))
_DROPPED = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or 9 <= b <= 13 or 28 <= b <= 32))


def squashed_words(text: str, known: dict[str, str]) -> list[str]:
    """The words of ``text``, each ``squashed``; ``known`` keeps those of other than plain letters from text to text."""
    t = _TAGS.sub(" ", text) if "<" in text else text
    if t.isascii() and "&" not in t:
        return t.encode().translate(_LOWER, _DROPPED).decode().split()
    out = []
    for x in t.split():
        w = known.get(x)
        if w is None:
            w = known[x] = squashed(x)
        if w:
            out.append(w)
    return out


# ---------------------------------------------------------------- FM-index


def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How many of the first ``i`` bits are set."""
    w = i >> 6
    mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
    return counts[w] + np.bitwise_count(words[w] & mask)


def _bits(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits packed 64 to a word, little end first, with the number of set bits before each word."""
    n = (len(b) >> 6) + 1
    padded = np.zeros(n * 64, dtype=np.uint8)
    padded[: len(b)] = b
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    counts = np.zeros(n, dtype=np.int64)
    np.cumsum(np.bitwise_count(words)[:-1], out=counts[1:])
    return words, counts


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit plane at a time."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        self.depth, self.planes = depth, []
        for level in range(depth - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            words, counts = _bits(bit)
            self.planes.append((words, counts, int(len(bit) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``c`` occurs before position ``i``."""
        start = np.zeros_like(i)
        for k, (words, counts, zeros) in enumerate(self.planes):
            one = (c >> (self.depth - 1 - k)) & 1 == 1
            a, b = _ones(words, counts, start), _ones(words, counts, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for words, counts, zeros in self.planes:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            c = (c << 1) | one
            a, b = _ones(words, counts, start), _ones(words, counts, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return c, i - start


def suffix_array(t: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of ``t``, which ends with a 0, in order; each 0 counts as a symbol of its own, smaller than all others and ordered by its place.

    The first symbols, as many as fit into one integer, are sorted at once; what they leave equal is refined by the ranks
    of the suffixes further on, twice as far each time.
    """
    n, k = len(t), max(1, 60 // bits)
    zero = np.flatnonzero(t == 0)
    pos = np.flatnonzero(t)
    if not len(pos):
        return zero
    ahead = np.concatenate([t.astype(np.int64), np.zeros(k, dtype=np.int64)])
    key, alive = np.zeros(len(pos), dtype=np.int64), np.ones(len(pos), dtype=bool)
    for j in range(k):
        s = ahead[pos + j] * alive
        alive &= s > 0  # nothing counts beyond the first 0
        key = (key << bits) | s
    order = np.argsort(key, kind="stable")
    pos, key, alive = pos[order], key[order], alive[order]
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[zero] = np.arange(len(zero))
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | ~alive[1:]  # equal up to a 0: the zeros' order, which is the places' order, decides
    group = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
    rank[pos] = len(zero) + group
    step = k
    while True:
        size = np.bincount(group, minlength=len(pos))
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        p, g = pos[tied], group[tied]
        second = rank[np.minimum(p + step, n)]
        o = np.lexsort((p, second, g))
        p, g, second = p[o], g[o], second[o]
        split = np.ones(len(p), dtype=bool)
        split[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
        pos[tied] = p
        group[tied] = np.maximum.accumulate(np.where(split, tied, 0))
        rank[p] = len(zero) + group[tied]
        step *= 2
    return np.concatenate([zero, pos])


class FMIndex:
    """Backward search over a sequence whose 0s part it into runs, with suffix positions sampled every ``sample`` and at each run's start."""

    def __init__(self, t: np.ndarray, symbols: int, sample: int = 8) -> None:
        bits = max(1, int(symbols).bit_length())
        if not len(t) or t[-1] != 0:
            t = np.append(t, 0)  # the last run needs an end as well
        sa = suffix_array(t, bits)
        before = np.where(sa > 0, t[sa - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols + 1))]).astype(np.int64)
        self.bwt = WaveletMatrix(before.astype(np.int64), bits)
        known = (before == 0) | (sa % sample == 0)
        self.known, self.kept = _bits(known), sa[known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of suffixes that begin with each pattern, a row of symbols other than 0."""
        c = patterns[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, j]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of rows: each walks back to a sampled one."""
        out, cur, steps, todo = np.zeros_like(rows), rows.copy(), np.zeros_like(rows), np.arange(len(rows))
        words, counts = self.known
        while len(todo):
            at = cur[todo]
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            done = todo[hit]
            out[done] = self.kept[_ones(words, counts, cur[done])] + steps[done]
            todo = todo[~hit]
            if len(todo):
                c, r = self.bwt.access_rank(cur[todo])
                cur[todo] = self.first[c] + r
                steps[todo] += 1
        return out


# ---------------------------------------------------------------- passages


class Passages:
    """The phrases to search for, and the exact test of a document against an item.

    Phrases are ``width`` words in a row. Kept are those that at most ``shared`` items hold, and of every ``run`` consecutive
    words the two that fewest items hold, so every run of a passage has phrases of its own to be found by.
    """

    def __init__(self, items: list[tuple[int, str | None]], *, width: int = 4, run: int = 12, part: float = 0.75, shared: int = 3) -> None:
        self.width, self.run, self.part = width, run, part
        self.items: list[tuple[int, list[str], list[str]]] = []
        held: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        grams: list[list[tuple[bytes, ...]]] = []
        for item, passage in items:
            words = [w for w in (squashed(x) for x in (passage or "").split()) if w]
            seq = word_bytes(passage or "").split()
            self.items.append((item, words, ["".join(words[i : i + run]) for i in range(len(words) - run + 1)]))
            g = [tuple(seq[i : i + width]) for i in range(len(seq) - width + 1)]
            grams.append(g)
            for x in g:
                held[x].add(len(grams) - 1)
        chosen = {x for x, who in held.items() if len(who) <= shared}
        for g in grams:
            for i in range(max(1, len(g) - (run - width))):
                chosen.update(sorted(set(g[i : i + run - width + 1]), key=lambda x: (len(held[x]), x))[:2])
        self.phrases = sorted(chosen)
        vocabulary = sorted({w for x in self.phrases for w in x})
        self.symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.patterns = np.array([[self.symbol[w] for w in x] for x in self.phrases], dtype=np.int64).reshape(-1, width)
        self.owners = [sorted(held[x]) for x in self.phrases]
        self.masks = []
        for _, words, _ in self.items:
            m: dict[str, int] = defaultdict(int)
            for i, w in enumerate(words):
                m[w] |= 1 << i
            self.masks.append(m)

        self.word = {w: i + 1 for i, w in enumerate(sorted({w for _, words, _ in self.items for w in words}))}
        self.ids = [np.array([self.word[w] for w in words], dtype=np.int64) for _, words, _ in self.items]
        self._stretches()

    def _stretches(self, most: int = 24) -> None:
        """Hashes of all stretches of ``wide`` bytes of the passages' runs. A text that holds a run has one of them at a multiple of ``step``."""
        runs = [(k, r.encode()) for k, (_, _, rs) in enumerate(self.items) for r in rs]
        least = min((len(r) for _, r in runs), default=1)
        self.wide = min(most, least)
        self.step = least - self.wide + 1
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, self.wide, dtype=np.uint64) | np.uint64(1)
        owners: dict[int, set[int]] = defaultdict(set)
        for k, r in runs:
            for h in self._hashes(r, 1)[0].tolist():
                owners[h].add(k)
        self.stretches = np.array(sorted(owners), dtype=np.uint64)
        self.stretch_owners = [sorted(owners[h]) for h in self.stretches.tolist()]

    def _hashes(self, b: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the stretches at the multiples of ``step``."""
        at = np.arange(0, max(0, len(b) - self.wide + 1), step)
        raw, h = np.frombuffer(b, dtype=np.uint8), np.zeros(len(at), dtype=np.uint64)
        for j in range(self.wide):
            h += raw[at + j] * self.factors[j]
        return h, at

    def run_hits(self, squash: list[str]) -> dict[int, set[int]]:
        """Text number -> items of which a run may stand in the text, given without spaces; none is left out."""
        out: dict[int, set[int]] = defaultdict(set)
        if not len(self.stretches):
            return out
        raw = [s.encode() for s in squash]
        ends = np.cumsum([len(x) + 1 for x in raw])
        whole = b"\0".join([*raw, b""])  # no stretch holds a 0
        part = self.step << 20
        for lo in range(0, len(whole), part):
            h, at = self._hashes(whole[lo : lo + part + self.wide - 1], self.step)
            i = np.minimum(np.searchsorted(self.stretches, h), len(self.stretches) - 1)
            hit = np.flatnonzero(self.stretches[i] == h)
            for d, x in zip(np.searchsorted(ends, lo + at[hit], side="right").tolist(), i[hit].tolist(), strict=True):
                out[d].update(self.stretch_owners[x])
        return out

    def _span(self, m: int) -> int:
        return m + max(6, m // 3)

    def _need(self, m: int) -> int:
        return max(1, math.ceil(round(m * self.part, 6)))

    def place_hits(self, docs: list[list[str]]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Text number -> item number -> places, first and last, between which ``part`` of the item's words may begin; none is left out.

        A text that keeps all but ``lost`` words of an item keeps all but ``lost`` of any of its words, so the words that are rarest in the
        shard are counted: ``lost`` of them more than may be missing, within the stretch that the rule allows.
        """
        out: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        get = self.word.get
        t = np.array([i for d in docs for i in [get(w, 0) for w in d]], dtype=np.int64)
        ends = np.cumsum([len(d) for d in docs])
        times = np.bincount(t, minlength=len(self.word) + 1)
        order = np.argsort(t, kind="stable")
        first = np.concatenate([[0], np.cumsum(times)])
        for k, ids in enumerate(self.ids):
            m = len(ids)
            if not m:
                continue
            need, span = self._need(m), self._span(m)
            lost = m - need
            rare = ids[np.argsort(times[ids], kind="stable")[: min(m, 2 * lost + 1)]]
            least = len(rare) - lost
            at = np.sort(np.concatenate([order[first[w] : first[w + 1]] for w in np.unique(rare).tolist()]))
            if len(at) < least:
                continue
            a, b = at[: len(at) - least + 1], at[least - 1 :]
            near = np.flatnonzero(b - a < span)
            a, b = a[near], b[near]
            d = np.searchsorted(ends, a, side="right")
            one = b < ends[d]
            start = ends[d] - np.array([len(docs[i]) for i in d.tolist()], dtype=np.int64)
            for i, x, y in zip(d[one].tolist(), (b - span + 1 - start)[one].tolist(), (a - start)[one].tolist(), strict=True):
                have = out[i][k]
                if have and x <= have[-1][1] + 1:
                    have[-1] = (have[-1][0], max(y, have[-1][1]))
                else:
                    have.append((max(0, x), y))
        return out

    def within(self, k: int, doc: list[str], lo: int, hi: int) -> bool:
        """Whether ``part`` of item ``k``'s words occur in their order in a stretch of ``doc`` that begins between ``lo`` and ``hi``."""
        words, mask = self.items[k][1], self.masks[k]
        m = len(words)
        need, span, full = self._need(m), self._span(m), (1 << m) - 1

        def kept(b: int, e: int) -> int:
            v = full
            for w in doc[b:e]:
                if u := v & mask.get(w, 0):
                    v = ((v + u) | (v - u)) & full
            return m - v.bit_count()

        if kept(lo, hi + span) < need:
            return False
        return any(doc[b] in mask and kept(b, b + span) >= need for b in range(lo, min(hi + 1, len(doc))))


    def spans(self, k: int, text: str) -> list[tuple[int, int]]:
        """The character spans of ``text``, merged and in order, that hold what ``text`` has of item ``k``: every run of it, and every place that the second rule holds of."""
        shown = _TAGS.sub(lambda m: " " * len(m[0]), text)  # offsets stay
        tokens = [(q, m.start(), m.end()) for m in re.finditer(r"\S+", shown) if (q := squashed(m[0]))]
        words, runs = self.items[k][1], self.items[k][2]
        at, starts, n = [], [], 0
        for i, (q, _, _) in enumerate(tokens):
            starts.append(n)
            n += len(q)
            at += [i] * len(q)
        whole, found = "".join(q for q, _, _ in tokens), []
        for r in runs:
            j = whole.find(r)
            while j >= 0:
                found.append((at[j], at[j + len(r) - 1]))
                j = whole.find(r, j + 1)
        doc, mask, m = [q for q, _, _ in tokens], self.masks[k], len(words)
        need, span, full = self._need(m), self._span(m), (1 << m) - 1
        best: tuple[int, int, int] | None = None  # words kept, minus the length, and the first word of the best of places that overlap
        reach = -1
        for b in range(len(doc) if m else 0):
            if doc[b] not in mask:
                continue
            v, kept, last = full, 0, b
            for i in range(b, min(b + span, len(doc))):
                if u := v & mask.get(doc[i], 0):
                    v = ((v + u) | (v - u)) & full
                    if m - v.bit_count() > kept:
                        kept, last = m - v.bit_count(), i
            if kept < need:
                continue
            if best and b > reach:
                found.append((best[2], best[2] - best[1]))
                best = None
            best, reach = max(best or (0, 0, 0), (kept, b - last, b)), max(reach, last)
        if best:
            found.append((best[2], best[2] - best[1]))
        out: list[tuple[int, int]] = []
        for a, z in sorted(found):
            x, y = tokens[a][1], tokens[z][2]
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], y))
            else:
                out.append((x, y))
        return out or [(0, len(text))]  # a text whose broken encoding hides where its words begin goes as a whole


def shard_hits(texts: list[str | None], p: Passages) -> dict[int, dict[int, list[int]]]:
    """Text number -> item number -> word places of the item's phrases, by an FM-index over all texts of the shard."""
    if not len(p.patterns):
        return {}
    get, parts, ends, n = p.symbol.get, [], [], 0
    for t in texts:
        ids = [get(w, 0) for w in word_bytes(t).split()] if t else []
        parts.append(np.array(ids + [0], dtype=np.int32))
        n += len(ids) + 1
        ends.append(n)
    t = np.concatenate(parts)
    keep = (t > 0) | np.concatenate([[True], t[1:] + t[:-1] > 0])  # one 0 is enough between two runs
    place = np.flatnonzero(keep)
    t = t[keep]
    index = FMIndex(t, len(p.symbol))
    lo, hi = index.search(p.patterns)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return {}
    times = (hi - lo)[found]
    rows = np.repeat(lo[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = place[index.locate(rows)]
    doc = np.searchsorted(np.array(ends), at, side="right")
    start = np.concatenate([[0], ends[:-1]])[doc]
    out: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for ph, d, a in zip(np.repeat(found, times).tolist(), doc.tolist(), (at - start).tolist(), strict=True):
        for k in p.owners[ph]:
            out[d][k].append(a)
    return out


def _shards(batches: Iterator[pd.DataFrame], most: int = 1 << 25) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts of each shard: an Arrow batch, cut where its texts exceed ``most`` characters; a longer text is a shard of its own."""
    for b in batches:
        ids, texts = b["doc_id"].tolist(), b["text"].tolist()
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > most:
                yield ids[start:i], texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(ids):
            yield ids[start:], texts[start:]


def leaked_spans(documents: DataFrame, items: DataFrame, *, run: int = 12, part: float = 0.75, block: int = 5000) -> DataFrame:
    """doc_id, item_id, start, end: where each document's text holds an item's passage, wholly or in part, as spans of characters.

    Held is a passage of which at least ``run`` consecutive words stand in the text, or at least ``part`` of its words in
    their order in one place with a few changed, dropped or put between; case, punctuation, spacing, markup, and how words
    and lines are broken do not count. Each Arrow batch of documents (or part of one, by size) is a shard with its own FM-index over the words that
    passages use; phrases are found by backward search through wavelet-tree ranks and located from sampled suffix positions. Beside them
    stand two searches that leave out no case of a rule: stretches of the squashed text for the first, the passage's words that are rarest
    in the shard, counted within one place, for the second. Every pair that any of the three meets is tested exactly, and the spans of a pair
    that overlap are merged (``removal_spans`` merges those of all items). Items are the stated query set:
    they go to every shard, in blocks of ``block``, and the corpus is read once. There is no shuffle but the last one, which drops repeats.

    Null and empty texts and passages are in no row; a passage of fewer than ``run`` words is found by the second rule only. Repeated
    documents give a row for each id. Empty tables give no rows.
    """
    rows = items.select("item_id", "passage").orderBy("item_id").collect()  # the query set
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, end int"
    blocks = [[(r[0], r[1]) for r in rows[b : b + block]] for b in range(0, len(rows), block)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        passages = [Passages(q, run=run, part=part) for q in blocks]
        for ids, texts in _shards(batches):
            found, squash, docs = [], [squashed(t) for t in texts], [squashed_words(t, known) for t in texts]
            for p in passages:
                by_phrase, by_run, by_place = shard_hits(texts, p), p.run_hits(squash), p.place_hits(docs)
                for d in by_phrase.keys() | by_run.keys() | by_place.keys():
                    places = by_place.get(d, {})
                    for k in set(by_phrase.get(d, ())) | by_run.get(d, set()) | places.keys():
                        if any(w in squash[d] for w in p.items[k][2]) or any(p.within(k, docs[d], lo, hi) for lo, hi in places.get(k, ())):
                            found += [(ids[d], p.items[k][0], a, z) for a, z in p.spans(k, texts[d])]
            if len(known) > 1 << 18:
                known.clear()
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end"])

    return documents.select("doc_id", "text").where("text is not null and text <> ''").mapInPandas(search, kinds).distinct()


def removal_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, end: the spans of all items merged for each document, in order and apart from each other: what to take out of its text."""
    w = W.partitionBy("doc_id").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    x = spans.select("doc_id", "start", "end").withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return x.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def leaked_passages(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id: each document whose text holds an item's passage, wholly or in part, as ``leaked_spans`` finds it."""
    return leaked_spans(documents, items, **options).select("doc_id", "item_id").distinct()
