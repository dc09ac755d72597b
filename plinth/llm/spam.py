"""Keyword-stuffed and link-list pages by their rank-frequency curves, fitted in SQL windows; an exact share settles close calls."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import spam_model
from plinth.llm.match import fit_logistic
from plinth.session import written

_LINK = re.compile(r"<a\s[^<>]{0,400}>.{0,300}?</a>|\[[^\]\n]{1,160}\]\(\s*(?:https?:)?//[^)\s]*\)|(?:https?://|www\.)[^\s|,;<>\"]+", re.I | re.S)
#: A link's title with the site it leads to, on a line of its own.
_SITE = re.compile(r"^(.{2,90}?)\s*[-–|(]\s*(?:[\w-]+\.)+(?:example|test|invalid|com|in|org|net|info|biz)\)?\s*$", re.I)
#: What every match of ``_LABEL`` holds.
_LABELLED = re.compile(r"[:»–-]")
#: What every match of ``_SITE`` holds.
_DASH = re.compile(r"[-–|(]")
_TAG = re.compile(r"(?<![\w&])#\w[\w-]*")
_MARKUP = re.compile(r"<[^<>]{0,300}>|&(?:[a-z]{2,8}|#\d{1,6});", re.I)
_WORD = re.compile(r"[\wऀ-ॿ]+")
_PART = re.compile(r"\s*[|;,★•»·►→~/]\s*|\s{2,}|\s[-–*]\s")
#: What every match of ``_PART`` holds.
_PARTED = re.compile(r"[|;,★•»·►→~/]|\s[\s*–-]")
_END = re.compile(r"[.!?।][\"')\]]*\s*$")
_SENTENCES = re.compile(r"(?<=[.!?।])\s+")
_LABEL = re.compile(r"^\W*(?:tags?|labels?|keywords?|searches|related searches|popular searches|see also|also read|see)\s*[:»\-–]\s*", re.I)
#: What looks like a number but belongs to a search phrase or a place's name.
_NO_FACT = re.compile(r"\b\d+(?:\.\d)?[\s-]*(?:bhk|बीएचके)(?![\wऀ-ॿ])|\b(?:sector|phase)[\s-]*\d+\s?[a-d]?\b|(?:सेक्टर|फेज)\s*\d+\s?[a-d]?", re.I)
_FACT = re.compile(r"\d|:\s|[₹%]")
_INK = re.compile(r"\s+")


def _ink(s: str) -> int:
    """Characters of a text without its white space."""
    return len(_INK.sub("", s))


def _plain(s: str) -> str:
    return " ".join(_WORD.findall(s.lower().replace("-", " ").replace("_", " ")))


def stuffed_share(text: str, *, density: float = 0.02, cover: float = 0.3) -> float:
    """The share of a text's characters, without white space and markup, that are repeated search phrases, bare links or link titles, or tags.

    Links and tags count as they stand, unless four or more other words on the line go with each link (an annotated source).
    Sentences do not count, but a piece of five words or more does if pairs of words that make up ``density`` of the whole text and
    occur three times cover ``cover`` of it. Phrases of a list count if they, their first or their last two words recur; the rest of
    a list does as well if a third of its phrases do. Lines that state a number, a sum or a value after a colon are facts.
    """
    good = bad = 0
    lists: list[list[tuple[str, int]]] = []
    pieces: list[tuple[list[str], int]] = []
    lines = text.split("\n")
    many = sum(1 for x in lines if x.strip()) >= 3
    for line in lines:
        links = _LINK.findall(line) if "/" in line else []
        if links:
            line = _LINK.sub(" \x00 ", line)
        tags = _TAG.findall(line) if "#" in line else []
        if tags:
            line = _TAG.sub(" ", line)
            bad += sum(map(len, tags))
        if "<" in line or "&" in line:
            line = _MARKUP.sub(" ", line)
        rest = line.replace("\x00", " ") if links else line
        if links:
            n = sum(_ink(_MARKUP.sub("", x)) if x[:1] != "<" else _ink(x) for x in links)
            if len(_WORD.findall(_LABEL.sub("", rest))) >= 4 * len(links) and _END.search(rest) is not None or (":" in rest and len(_WORD.findall(rest)) >= 4 * len(links)):
                good += n
            else:
                bad += n
        rest = _LABEL.sub("", rest.strip(), count=1)
        if not rest:
            continue
        if _DASH.search(rest) is not None and _SITE.match(rest):
            bad += _ink(rest)
            continue
        block: list[tuple[str, int]] = []
        for s in _SENTENCES.split(rest):
            s = s.strip()
            if _LABELLED.search(s) is not None:
                s = _LABEL.sub("", s, count=1)
            words = _plain(s).split()
            if not words:
                continue
            parts = [x for x in _PART.split(s) if x and _WORD.search(x)] if _PARTED.search(s) is not None else [s]
            if _END.search(s) and len(words) >= 3 * max(1, len(parts)) or len(parts) <= 2 and len(words) >= 10:
                pieces.append((words, _ink(s)))
            else:
                facts = [_FACT.search(_NO_FACT.sub(" ", x)) is not None for x in parts]
                if many and any(facts) and len(s) < 200:
                    good += _ink(s)
                else:
                    for x, is_fact in zip(parts, facts, strict=True):
                        if is_fact:
                            good += _ink(x)
                        else:
                            block.append((_plain(x), _ink(x)))
        if block:
            lists.append(block)
    if pieces:
        pairs: Counter = Counter()
        total = sum(len(w) for w, _ in pieces)
        for w, _ in pieces:
            pairs.update(zip(w, w[1:]))
        often = max(3, density * total)
        frequent = {p for p, times in pairs.items() if times >= often}
        for w, n in pieces:
            if len(w) >= 5 and sum(p in frequent for p in zip(w, w[1:])) >= cover * (len(w) - 1):
                bad += n
            else:
                good += n
    if lists:
        phrases = Counter(q for b in lists for q, _ in b)
        heads = Counter(" ".join(q.split()[:2]) for b in lists for q, _ in b)
        tails = Counter(" ".join(q.split()[-2:]) for b in lists for q, _ in b)
        again = lambda q: phrases[q] >= 2 or heads[" ".join(q.split()[:2])] >= 3 or tails[" ".join(q.split()[-2:])] >= 3
        whole = [x for b in lists for x in b]
        much = sum(again(q) for q, _ in whole) >= len(whole) / 3 and len(whole) >= 4
        for q, n in whole:
            if again(q) or much and len(q.split()) <= 9:
                bad += n
            else:
                good += n
    return bad / (good + bad) if good + bad else 0.0


#: Words, and every other mark as a word of its own: the marks between links, tags and phrases shape the curve as well.
_TOKEN = re.compile(r"[\wऀ-ॿ]+|[^\w\sऀ-ॿ]")
#: Marks that have a share of their own; all others share one.
MARKS = (".", ",", "#", "-", "/", "|")
CLASSES = 9


def spectra(documents: DataFrame) -> DataFrame:
    """doc_id, page, script, n, unit, f, v: for each text the number ``v`` of distinct entries that occur ``f`` times among its ``n`` words and marks.

    The spectrum holds a page's rank-frequency curves in a handful of rows: of its words (unit ``w``), of the pairs of neighbouring words and
    marks (``b``), and of its marks, one row each (``.`` and so on, ``*`` for the rest). ``page`` tells texts of one doc_id apart. ``script``
    tells prose of one language from another's by its letters, as ``lang`` is often missing.
    """
    named = set(MARKS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, p, t in zip(b["doc_id"].tolist(), b["page"].tolist(), b["text"].tolist(), strict=True):
                tokens = _TOKEN.findall(t.lower())
                if not tokens:
                    continue
                n, times = len(tokens), Counter(tokens)
                own = 0 if t.isascii() else sum(f for w, f in times.items() if "ऀ" <= w[0] <= "ॿ")
                script = "deva" if 2 * own > n else "latn"
                marks: Counter = Counter()
                for w in [w for w in times if len(w) == 1 and not w.isalnum()]:
                    marks[w if w in named else "*"] += times.pop(w)
                for unit, c in (("w", Counter(times.values())), ("b", Counter(Counter(zip(tokens, tokens[1:])).values()))):
                    out += [(i, p, script, n, unit, f, v) for f, v in c.items()]
                out += [(i, p, script, n, m, f, 1) for m, f in marks.items()]
            yield pd.DataFrame(out, columns=["doc_id", "page", "script", "n", "unit", "f", "v"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _pages(documents).mapInPandas(count, f"doc_id {kind}, page long, script string, n int, unit string, f int, v int")


def _pages(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where("text is not null and text <> ''").withColumn("page", F.xxhash64("text"))


def curve_features(spectrum: DataFrame) -> DataFrame:
    """One row for each page: doc_id, page, script, n, and the shape of its curves.

    Slope and residual (``w_slope``, ``b_residual``) are of the least-squares line through log frequency over log rank, each entry one point,
    those of one frequency at the middle of their ranks. ``w_c0`` to ``w_c8`` are the shares of the page's entries that occur once, two to
    three times, four to seven times and so on; ``w_types`` is the distinct share, ``w_top`` the commonest entry's. ``w_divergence`` is the
    Kullback-Leibler divergence of these shares from those of prose of the same script and length (``spam_model.PROSE``). ``m_0`` to ``m_6``
    are the marks' shares. No row depends on any other page.
    """
    x = spectrum.repartition("doc_id", "page").distinct()  # repeated rows are one page; this, the window and the sums below work on one partitioning
    x.createOrReplaceTempView("__plinth_spectrum")
    ranked = spectrum.sparkSession.sql("""
        SELECT *, ln(f) AS y, ln(sum(v) OVER (PARTITION BY doc_id, page, unit ORDER BY f DESC ROWS UNBOUNDED PRECEDING) - v / 2.0D + 0.5D) AS x,
               least(cast(floor(log2(f)) AS int), 8) AS class
        FROM __plinth_spectrum""")
    sums = [F.first("script").alias("script"), F.first("n").alias("n")]
    for u in ("w", "b"):
        of = lambda e, u=u: F.coalesce(F.sum(F.when(F.col("unit") == u, F.expr(e))), F.lit(0.0))
        sums += [of(e).alias(f"{u}_{k}") for k, e in {"t": "v", "k": "f * v", "sx": "v * x", "sy": "v * y", "sxx": "v * x * x", "sxy": "v * x * y", "syy": "v * y * y"}.items()]
        sums += [of(f"if(class = {c}, f * v, 0)").alias(f"{u}_n{c}") for c in range(CLASSES)]
        sums += [F.coalesce(F.max(F.when(F.col("unit") == u, F.col("f"))), F.lit(0)).alias(f"{u}_most")]
    sums += [F.coalesce(F.sum(F.when(F.col("unit") == m, F.col("f"))), F.lit(0)).alias(f"m{i}") for i, m in enumerate((*MARKS, "*"))]
    x = ranked.groupBy("doc_id", "page").agg(*sums)
    one, two = {}, {}  # in steps, each on the columns of the one before, so that no expression is written out more than once
    for u in ("w", "b"):
        k, t = F.greatest(F.col(f"{u}_k"), F.lit(1.0)), F.greatest(F.col(f"{u}_t"), F.lit(1.0))
        c = lambda a, b, p, u=u, t=t: F.col(f"{u}_{p}") - F.col(f"{u}_{a}") * F.col(f"{u}_{b}") / t
        one |= {f"{u}_vxx": c("sx", "sx", "sxx"), f"{u}_vxy": c("sx", "sy", "sxy"), f"{u}_vyy": c("sy", "sy", "syy")}
        one |= {f"{u}_types": F.col(f"{u}_t") / k, f"{u}_top": F.col(f"{u}_most") / k} | {f"{u}_c{i}": F.col(f"{u}_n{i}") / k for i in range(CLASSES)}
        vxx, vxy, vyy = (F.col(f"{u}_{v}") for v in ("vxx", "vxy", "vyy"))
        two |= {f"{u}_slope": F.when(vxx > 1e-9, vxy / vxx).otherwise(0.0), f"{u}_residual": F.sqrt(F.greatest(F.lit(0.0), (vyy - F.when(vxx > 1e-9, vxy * vxy / vxx).otherwise(0.0)) / t)), f"{u}_divergence": _divergence(u)}
    one |= {f"m_{i}": F.col(f"m{i}") / F.col("n") for i in range(len(MARKS) + 1)} | {"length": _length()}
    return x.withColumns(one).withColumns(two).select("doc_id", "page", "script", "n", *FEATURES)


def _length() -> Column:
    return F.log(F.col("n").cast("double"))


def _divergence(unit: str) -> Column:
    """Of the shares ``<unit>_c<i>`` from those of prose of the page's script at its length, which are quadratics in the length's logarithm."""
    coefficients = F.when(F.col("script") == "deva", _rows(spam_model.PROSE[unit]["deva"])).otherwise(_rows(spam_model.PROSE[unit]["latn"]))
    want = F.transform(coefficients, lambda q: F.greatest(F.lit(0.002), q[0] + q[1] * F.col("length") + q[2] * F.col("length") * F.col("length")))
    each = F.zip_with(F.array(*[F.col(f"{unit}_c{i}") for i in range(CLASSES)]), want, lambda p, q: F.struct(F.when(p > 0, p * F.log(p / q)).otherwise(0.0).alias("kl"), q.alias("q")))
    both = F.aggregate(each, F.struct(F.lit(0.0).alias("kl"), F.lit(0.0).alias("q")), lambda s, e: F.struct((s["kl"] + e["kl"]).alias("kl"), (s["q"] + e["q"]).alias("q")), lambda s: s["kl"] + F.log(s["q"]))
    return F.when(F.col(f"{unit}_k") > 0, both).otherwise(0.0)


def _rows(table: list) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table])


FEATURES = [f"{u}_{k}" for u in ("w", "b") for k in ("slope", "residual", "divergence", "types", "top", *[f"c{i}" for i in range(CLASSES)])] + [f"m_{i}" for i in range(len(MARKS) + 1)]


def curve_score() -> Column:
    """The log odds, from its curves alone, that more than half of a page is stuffed: ``spam_model.WEIGHTS`` over ``FEATURES``, each weighing differently with length."""
    z = F.lit(spam_model.INTERCEPT[0]) + F.lit(spam_model.INTERCEPT[1]) * _length() + F.lit(spam_model.INTERCEPT[2]) * _length() * _length() + F.when(F.col("script") == "deva", F.lit(spam_model.INTERCEPT[3])).otherwise(0.0)
    for k in FEATURES:
        a, b = spam_model.WEIGHTS[k]
        z = z + F.col(k) * (F.lit(a) + F.lit(b) * _length())
    return z


def fit_prose(features: pd.DataFrame, stuffed: pd.Series) -> dict:
    """``PROSE``: for each unit, script and class the quadratic in log length that fits the shares of the pages that are not stuffed."""
    out: dict = {}
    for u in ("w", "b"):
        out[u] = {}
        for script in ("latn", "deva"):
            rows = features[(features["script"] == script) & ~stuffed]
            length = np.log(rows["n"].to_numpy(dtype=float))
            x = np.stack([np.ones_like(length), length, length**2], axis=1)
            w = np.linalg.solve(x.T @ x + np.diag([1e-6, 1e-4, 1e-4]), x.T @ rows[[f"{u}_c{i}" for i in range(CLASSES)]].to_numpy(dtype=float))
            out[u][script] = [tuple(round(float(v), 5) for v in w[:, i]) for i in range(CLASSES)]
    return out


def fit_weights(features: pd.DataFrame, stuffed: pd.Series, ridge: float = 1.0) -> tuple[dict, tuple]:
    """``WEIGHTS`` and ``INTERCEPT`` by ridge logistic regression on standardised features, brought back to the features' own scale."""
    length = np.log(features["n"].to_numpy(dtype=float))
    base = features[FEATURES].to_numpy(dtype=float)
    x = np.concatenate([base, base * length[:, None], length[:, None], (length**2)[:, None], (features["script"] == "deva").to_numpy(dtype=float)[:, None]], axis=1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = fit_logistic((x - mean) / scale, stuffed.to_numpy(dtype=float), ridge=ridge)
    own = w[:-1] / scale
    k = len(FEATURES)
    weights = {f: (round(float(own[i]), 4), round(float(own[k + i]), 4)) for i, f in enumerate(FEATURES)}
    return weights, tuple(round(float(v), 4) for v in (w[-1] - (own * mean).sum(), own[2 * k], own[2 * k + 1], own[2 * k + 2]))


def training_rows(documents: DataFrame, most: int = 20_000) -> pd.DataFrame:
    """Features and weak label (``share``, by ``stuffed_share``) of at most ``most`` distinct texts, those of the least hashes: what the model is fitted on."""
    texts = _pages(documents).groupBy("page").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).orderBy("page").limit(most)
    rows = curve_features(spectra(texts)).toPandas()
    share = texts.select("page", "text").toPandas().set_index("page")["text"].map(stuffed_share)
    return rows.assign(share=share.reindex(rows["page"]).to_numpy())


def stuffed_pages(documents: DataFrame, *, least: float = -3.0) -> DataFrame:
    """doc_id, score, slope, residual, divergence of the pages of which more than half is search phrases, links or tags.

    A page's rank-frequency curves flag it: ``curve_score`` weighs slope, residual, divergence from prose of its script and length, and the
    curves' ends, and a page whose log odds are under ``least`` is none. The exact share of each flagged page (``stuffed_share``) follows, as
    a table of rates in pipes has the curve of a list of tags. No page's result depends on another page, so neither the corpus' size nor
    copies change it.

    Null and empty texts, and texts without a word or mark, are in no row. Rows of one id with one text are one page; an id with several
    texts has a row for each that is found. Empty input gives an empty result; further columns are ignored. Runs a job.
    """
    shown = [F.col(f"w_{k}").alias(k) for k in ("slope", "residual", "divergence")]
    scored = curve_features(spectra(documents)).withColumn("score", curve_score())
    flagged = written(scored.where(F.col("score") >= least).select("doc_id", "page", "score", *shown), "flagged")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["text"].map(stuffed_share).astype("float64") > 0.5].drop(columns=["text", "page"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flagged.schema if f.name != "page")
    own = _pages(documents).withColumnRenamed("page", "__page").withColumnRenamed("doc_id", "__doc")
    texts = own.join(flagged, (F.col("__page") == F.col("page")) & F.col("__doc").eqNullSafe(F.col("doc_id"))).select(*flagged.columns, "text")  # broadcast by Spark only while the written table is small
    return texts.mapInPandas(check, kinds).distinct()
