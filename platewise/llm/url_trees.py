"""URL filter: listed rules first, gradient-boosted trees on lexical features for what no rule fits.

URLs that a rule fits are the labelled ones; the trees learn from a bounded sample of them and judge the rest. Features are those of the URL's text
(length, depth, digit ratio, entropy, parameter counts and the like) and of its host's suffixes, alone and with the first directory of the path: how many URLs lie
below each, counted over all rows, and which part of its labelled ones is blocked. Labelled URLs fall into five folds by their hash: one is held out, two
count for the suffixes and the trees learn from the other two, so that no URL's own label is among its features.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, slices, staged
from platewise.llm.labelled import FOLDS, HELD_OUT

#: Labelled URLs that are learnt from at most: those with the smallest hash.
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, BINS, PENALTY = 40, 4, 0.3, 64, 1.0
#: Suffixes: labels of a host (0: all of them) and whether the first directory of the path belongs to it.
SUFFIXES = {"1": (1, False), "2": (2, False), "3": (3, False), "host": (0, False), "1_dir": (1, True), "2_dir": (2, True)}
#: Folds of labelled URLs that are counted for the suffixes; those that are neither here nor held out are for the trees.
COUNTED = (1, 2)
#: What a suffix without labelled URLs is taken to have: half a blocked one and half an allowed one.
PRIOR = 1.0
LEXICAL = ["length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "letters", "hyphens", "longest_part", "entropy", "host_entropy", "parameters", "values",
           "escapes", "secure", "fragment", "extension"]
NAMES = LEXICAL + [f"{what}_{k}" for k in SUFFIXES for what in ("known", "blocked")]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and the paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        at_host = (F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))
        return at_host & F.startswith(F.col("path"), F.lit(self.path))


def ruled(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """`host` and `path` with `rule` and `ruling`, the longest rule that fits and its verdict (of equally long ones the one listed first), or null."""
    found = [F.when(r.fits(), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("ruling"))) for r in sorted(rules, key=lambda r: -len(r.text))]
    none = F.lit(None).cast("struct<rule:string,ruling:string>")
    return df.withColumn("_found", F.coalesce(*found, none)).select("*", F.col("_found.rule").alias("rule"), F.col("_found.ruling").alias("ruling")).drop("_found")


def entropies(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bits a character of each of n byte strings that stand in a row."""
    keys, counts = np.unique(owner * 256 + codes, return_counts=True)
    sizes = np.maximum(np.bincount(owner, minlength=n), 1)
    share = counts / sizes[keys // 256]
    return np.bincount(keys // 256, weights=-share * np.log2(share), minlength=n)


def lexical(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """The features of LEXICAL for each URL."""
    out = np.zeros((len(urls), len(LEXICAL)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths)):
        bare, _, fragment = url.partition("#")
        query = bare.partition("?")[2]
        parts = [p for p in path.split("/") if p]
        pairs = [p for p in query.replace(";", "&").split("&") if p]
        n = max(1, len(url))
        out[i] = (len(url), len(host), len(path), len(query), len(parts), host.count(".") + 1 if host else 0, sum(map(str.isdigit, url)) / n, sum(map(str.isalpha, url)) / n,
                  url.count("-") + url.count("_"), max(map(len, [*parts, *host.split(".")])), 0, 0, len(pairs), sum("=" in p for p in pairs), url.count("%"), url[:8].lower() == "https://",
                  len(fragment), len(parts[-1].rpartition(".")[2]) if parts and "." in parts[-1] else 0)
    for at, texts in ((LEXICAL.index("entropy"), urls), (LEXICAL.index("host_entropy"), hosts)):
        raw = [t.encode() for t in texts]
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        out[:, at] = entropies(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), owner, len(raw))
    return out


@dataclass
class Trees:
    """Boosted trees of one depth, each a full binary tree in level order: a row goes right if its feature is above the threshold."""

    base: float
    rate: float = RATE
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += self.rate * leaf[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Of each feature the values that part its sorted column into about `bins` parts; a row's bin is the number of cut points below its value."""
    out = []
    for column in x.T:
        values = np.unique(column)
        out.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")))
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY) -> Trees:
    """Second-order boosting of the logistic loss over histograms of binned features. With no row or one kind of label the score is the label's mean."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    trees = Trees(float(np.log(mean / (1 - mean))), rate)
    if not len(y) or y.min() == y.max():
        return trees
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    n_features, width = x.shape[1], max(map(len, cuts)) + 1
    margin = np.full(len(y), trees.base)
    flat = binned + np.arange(n_features) * width
    usable = np.arange(width)[None, :] < np.array([len(c) for c in cuts])[:, None]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        features, thresholds = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first) * (n_features * width))[:, None] + flat
            sums = [np.bincount(at.ravel(), weights=np.repeat(v, n_features), minlength=many * n_features * width).reshape(many, n_features, width).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            worth = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            worth = np.where(usable[None], worth, 0).reshape(many, -1)
            best = worth.argmax(axis=1)
            f, b = best // width, best % width
            split = worth[np.arange(many), best] > 1e-9
            features[first: first + many] = f
            thresholds[first: first + many] = [cuts[i][j] if s else np.inf for i, j, s in zip(f, b, split)]
            own = node - first
            right = split[own] & (binned[np.arange(len(y)), f[own]] > b[own])
            node = 2 * node + 1 + right
        leaf = node - (2**depth - 1)
        value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        margin += rate * value[leaf]
        trees.features.append(features)
        trees.thresholds.append(thresholds)
        trees.leaves.append(value)
    return trees


def directory(path: Column) -> Column:
    """The first part of a path if another follows; else empty."""
    return F.regexp_extract(path, r"(?s)^/([^/]*)/", 1)


def suffix(labels: int, with_directory: bool) -> Column:
    host = F.substring_index("host", ".", -labels) if labels else F.col("host")
    return F.concat_ws("/", host, "dir") if with_directory else host


def fold(url: Column) -> Column:
    return F.coalesce(F.crc32(url) % FOLDS, F.lit(HELD_OUT))


def suffix_features(judged: DataFrame) -> DataFrame:
    """(host, dir, known_k, blocked_k, ...) over all rows of (host, dir, ruling, fold): for each suffix the logarithm of the URLs below it and the smoothed part of its counted
    labelled ones that is blocked. Rows are counted by (host, dir) first, so the joins see each once."""
    counts = F.col("ruling").isNotNull() & F.col("fold").isin(*COUNTED)
    each = judged.groupBy("host", "dir").agg(F.count("*").alias("n"), F.count(F.when(counts, 1)).alias("labelled"), F.count(F.when(counts & (F.col("ruling") == "block"), 1)).alias("blocked"))
    out = each = staged(each, "hosts")
    for name, (labels, with_directory) in SUFFIXES.items():
        key = f"_s{name}"
        part = each.groupBy(suffix(labels, with_directory).alias(key)).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        part = part.select(key, F.log1p("n").alias(f"known_{name}"), ((F.col("blocked") + PRIOR / 2) / (F.col("labelled") + PRIOR)).alias(f"blocked_{name}"))
        out = out.withColumn(key, suffix(labels, with_directory)).join(part, key).drop(key)
    return out.drop("n", "labelled", "blocked")


def with_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and `x`, the features in the order of NAMES as 64-bit floats, from _url, host, path and the suffix columns."""
    made = NAMES[len(LEXICAL):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_url"):
            texts = [[t or "" for t in part.column(c).to_pylist()] for c in ("_url", "host", "path")]
            x = np.concatenate([lexical(*texts), np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in made], axis=1)], axis=1)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    source = df.select(*(col(c) for c in dict.fromkeys([*keep, "_url", "host", "path", *made])))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x binary"]))


def fit(featured: DataFrame, rows: int = SAMPLE) -> Trees:
    """Trees from (_url, ruling, fold, x): at most `rows` distinct labelled URLs of their folds come to the driver, as features."""
    width = len(NAMES)
    known = featured.filter(F.col("ruling").isNotNull() & ~F.col("fold").isin(HELD_OUT, *COUNTED)).groupBy("_url").agg(F.min("ruling").alias("ruling"), F.min("x").alias("x"))
    got = known.orderBy(F.xxhash64("_url"), "_url").limit(rows).collect()
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, width)
    return train(x, np.array([r["ruling"] == "block" for r in got], float))


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), rows: int = SAMPLE) -> DataFrame:
    """`keep`, `host`, `path`, `rule`, `score` (0 to 1, higher: rather to be blocked), `verdict` and `held_out` (never learnt from) per row.

    The verdict is the rule's, else `block` from a score of one half on. A null URL counts as empty, with an empty host and path; repeated rows are judged each; other
    columns are left out; an empty table gives an empty result. Without labelled URLs every score is one half."""
    if {n.lower() for n in keep} & {"host", "path", "rule", "ruling", "score", "verdict", "held_out", "x", "_url", "dir", "fold", *NAMES}:
        raise ValueError("keep has the name of a column that is made here")
    read = pages.select(*[col(c) for c in keep], col(url).cast("string").alias("_url"))
    split = ruled(read.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}), rules)
    split = staged(split.withColumns({"dir": directory(F.col("path")), "fold": fold(F.col("_url"))}), "urls")
    names = [*keep, "_url", "host", "path", "rule", "ruling", "fold"]
    featured = staged(with_features(split.join(suffix_features(split), ["host", "dir"]), names), "featured")
    trees = fit(featured, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.frombuffer(b"".join(part.column("x").to_pylist())).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(trees.score(x))], [*part.schema.names[:-1], "score"])

    kept = [*keep, "host", "path", "rule", "ruling", "fold"]
    types = dict(featured.dtypes)
    scored = featured.select(*(col(c) for c in kept), "x").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "score double"]))
    verdict = F.coalesce("ruling", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*[col(c) for c in keep], "host", "path", "rule", "score", verdict.alias("verdict"), (F.col("fold") == HELD_OUT).alias("held_out"))
