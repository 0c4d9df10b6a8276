"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees see a URL's length, depth, digit ratio, entropy, parameter counts, and statistics of its host: the smoothed
share of blocked URLs among the labelled ones that end in the same suffix, or hold the same word. They are trained
from a table of labelled URLs; `labelled_urls` makes the default one by rule, with six kinds of URLs to be blocked,
each told by other features, and hyphens, digits, parameters and folders among the others too. The verdicts of the
rules are not used as labels: those rules go by place, and would teach that a language folder is bad.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged by the trees
on its text (null: the empty text); an even chance blocks; a very long URL is read whole; repeated rows get equal
verdicts; an empty table gives an empty result; without labelled URLs every chance is even; other columns are ignored
unless named in `keep`.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host and path prefix).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most labelled URLs that the trees are trained on; the table is taken in the order of its hashes.
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, LEAST_LEAF = 60, 4, 0.2, 10
#: URLs of the default table, and the share of its labels that are turned.
DEFAULT_LABELLED, NOISE = 4000, 0.02
#: Weight of the prior in a suffix's or word's statistic, and the fewest URLs that it is told from.
PRIOR_WEIGHT, LEAST_SEEN = 20, 5

# Words and suffixes that the default labelled table is made of, suffixes with their weights.
SPAM_WORDS = "casino poker slots jackpot betting bets bonus viagra cialis pills pharmacy payday loans credit replica watches cheap discount free prize winner adult porn xxx sex cam dating escort torrent crack keygen warez spam ads tracker".split()
PLAIN_SUFFIXES = "com com com com com com org org org org net net net edu edu de de fr es co.uk gov info io xyz".split()
BAD_SUFFIXES = "xyz xyz top top click click loan loan win bid buzz gq tk tk cf com net info".split()
FOLDERS = "news blog en de fr es archive category shop help about docs wiki forum 2019 2022 2024 05 11".split()


def labelled_urls(n: int = DEFAULT_LABELLED, seed: int = 3) -> list[tuple[str, int]]:
    """(url, 1 if to be blocked), made by rule. A URL to be blocked has one trait of six: a random host, many
    parameters, great depth, a suffix that few others have, advertised words in its host, or a host of digits. What
    its trait does not settle is drawn as for the other URLs."""
    rnd = random.Random(seed)

    def word(low: int = 1, high: int = 4) -> str:
        return "".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") + rnd.choice(("", "", "n", "r", "s", "st")) for _ in range(rnd.randint(low, high)))

    def code(low: int, high: int) -> str:
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(low, high)))

    def spam() -> str:
        return rnd.choice(SPAM_WORDS)

    out = []
    for k in range(n):
        trait = k // 2 % 6 if k % 2 else None
        joint = rnd.choice(("", "", "-"))
        name = joint.join(word() for _ in range(rnd.choice((1, 1, 2, 2, 3))))
        if rnd.random() < 0.1:
            name += str(rnd.randint(1, 2030))
        front = rnd.choice(("", "", "www.", "www.", word(1, 2) + "."))
        suffix = rnd.choice(PLAIN_SUFFIXES)
        parts = [rnd.choice((rnd.choice(FOLDERS), word(1, 3), "-".join(word(1, 3) for _ in range(rnd.randint(2, 6))))) for _ in range(rnd.choice((0, 1, 1, 2, 2, 3, 4)))]
        page = rnd.choice(("", "", str(rnd.randint(1, 99999)), word() + ".html", "-".join(word(1, 2) for _ in range(4)), f"{rnd.randint(1, 9999)}.html"))
        params = [f"{word(1, 2)}={rnd.choice((word(1, 2), str(rnd.randint(1, 500))))}" for _ in range(rnd.choice((0, 0, 0, 0, 1, 1, 2)))]
        if trait == 0:
            name = code(12, 28)
        elif trait == 1:
            params = [f"{code(1, 6)}={code(4, 24)}" for _ in range(rnd.randint(4, 10))]
        elif trait == 2:
            parts = [word(1, 2) for _ in range(rnd.randint(7, 14))]
        elif trait == 3:
            suffix = rnd.choice(BAD_SUFFIXES)
        elif trait == 4:
            name = rnd.choice(("", "-")).join([spam(), *rnd.choice(([], [spam()], [word(1, 2)], [spam(), spam()]))])
        elif trait == 5:
            name = rnd.choice((f"{word(1, 1)}{rnd.randint(10**5, 10**9)}", ".".join(str(rnd.randint(1, 254)) for _ in range(3)), f"{rnd.randint(10**3, 10**6)}-{rnd.randint(10, 10**4)}"))
        path = "/".join(["", *parts, page])
        tail = "?" + "&".join(params) if params else rnd.choice(("", "", "", "#" + word(1, 2)))
        label = int((trait is not None) != (rnd.random() < NOISE))
        out.append((f"{rnd.choice(('http', 'https'))}://{front}{name}.{suffix}{path}{tail}", label))
    return out


def split_url(df: DataFrame, column: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(column), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, text.substr(F.instr(text, "://") + 3, F.length(text))).otherwise("")
    return df.withColumns({"host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits (the longest, then the first in code-point order) and its verdict, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


HOST = re.compile(r"://([^/?#]*)")


WORDS = re.compile(r"[a-z]{2,}")
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "host_labels", "hyphens", "escapes", "longest_label", "suffix", "domain", "host_word")


def suffixes(host: str) -> tuple[str, str]:
    """The last label of a host, and its last two."""
    labels = host.lower().split(".")
    return labels[-1], ".".join(labels[-2:])


def entropy(text: str) -> float:
    n = max(1, len(text))
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def lexical(url: str, stats: dict[str, float], prior: float) -> list[float]:
    """The features of one URL, as FEATURES names them. stats: shares of suffixes, and of words under `word:`."""
    match = HOST.search(url)
    host = match[1].lower() if match else ""
    rest = url[match.end() :] if match else url
    query = rest.partition("?")[2].partition("#")[0]
    path = re.split(r"[?#]", rest, maxsplit=1)[0]
    last, last_two = suffixes(host)
    shares = [stats[k] for w in WORDS.findall(host) if (k := "word:" + w) in stats]
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host),
        entropy(url), entropy(host), query.count("=") if query else 0, len(query), host.count("."), host.count("-"), url.count("%"),
        max(map(len, re.split(r"[.\-_]", host)), default=0), stats.get(last, prior), stats.get(last_two, prior), max(shares, default=prior),
    ]


class Trees:
    """Gradient boosting of the logistic loss with small regression trees."""

    def __init__(self, labelled: list[tuple[str, int]]):
        y = np.array([b for _, b in labelled], float)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        seen, bad = Counter(), Counter()
        for url, b in labelled:
            match = HOST.search(url)
            host = match[1].lower() if match else ""
            for s in {*suffixes(host), *("word:" + w for w in WORDS.findall(host))} if host else ():
                seen[s] += 1
                bad[s] += b
        self.stats = {s: (bad[s] + PRIOR_WEIGHT * self.prior) / (n + PRIOR_WEIGHT) for s, n in seen.items() if n >= LEAST_SEEN}
        self.trees: list[list[tuple]] = []
        self.base = math.log(self.prior / (1 - self.prior))
        if not labelled:
            return
        x = self.features([u for u, _ in labelled])
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self.grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self.apply(tree, x)

    def features(self, urls: list[str]) -> np.ndarray:
        return np.array([lexical(u, self.stats, self.prior) for u in urls], float).reshape(len(urls), -1)

    def grow(self, tree: list[tuple], x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        own = len(tree)
        tree.append(())
        gain, best = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                lg, lh = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                ok = (v[1:] > v[:-1]) & (np.arange(1, len(v)) >= LEAST_LEAF) & (np.arange(len(v) - 1, 0, -1) >= LEAST_LEAF)
                if ok.any():
                    won = np.where(ok, lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1), -1)
                    k = int(won.argmax())
                    if won[k] > gain + 1e-9:
                        gain, best = float(won[k]), (f, float((v[k] + v[k + 1]) / 2))
        if best is None:
            tree[own] = (-1, RATE * float(total_g / (total_h + 1)))
        else:
            low = x[rows, best[0]] <= best[1]
            tree[own] = (*best, self.grow(tree, x, g, h, rows[low], depth - 1), self.grow(tree, x, g, h, rows[~low], depth - 1))
        return own

    @staticmethod
    def apply(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if tree[k][0] < 0:
                out[rows] = tree[k][1]
            else:
                low = x[rows, tree[k][0]] <= tree[k][1]
                todo += [(tree[k][2], rows[low]), (tree[k][3], rows[~low])]
        return out

    def chance(self, urls: list[str]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        x = self.features(urls)
        score = np.full(len(urls), self.base)
        for tree in self.trees:
            score += self.apply(tree, x)
        return 1 / (1 + np.exp(-score))


def train(labelled: DataFrame | None = None) -> Trees:
    """labelled: columns url and label (1: block); the default table if None."""
    if labelled is None:
        return Trees(labelled_urls())
    rows = labelled.where("url is not null and label is not null").select("url", "label").distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED).collect()
    return Trees([(r.url, int(r.label)) for r in rows])


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, model: Trees | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in `keep`, host, path, rule, the trees' chance of a block, and the verdict."""
    model = model or train()
    rule, verdict = rule_columns(RULES if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [x.as_py() or "" for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.round(model.chance(urls), 9))], [*batch.schema.names[1:], "chance"])

    split = split_url(C.text_first(pages, "url", keep), "_text")
    ruled = split.withColumns({"rule": rule, "_verdict": verdict})
    scored = C.arrow_map(ruled, run, C.with_fields(ruled.schema[1:], "chance double"))
    return scored.select("_kept.*", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("chance") >= 0.5, "block").otherwise("allow")).alias("verdict"), "chance")
