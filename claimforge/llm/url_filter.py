"""URL filter: rules of hosts and paths, and logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled table of URLs (a parameter); hosts and paths are n-grams of their
own. Parsing and rules are column expressions; n-gram scores are made in numpy over whole Arrow batches.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm import grams
from claimforge.llm.common import read_table, ship, utf8

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# What the small labelled table is made of: words of hosts that are to be blocked and of clean ones, and what surrounds them.
BLOCKED = "casino bets betting poker slots jackpot lottery gambling pills viagra pharmacy adult porn sex xxx escort cams dating spam spamlist scam malware phishing crack warez keygen torrent replica loans payday ads adserver tracker track popunder clickbait".split()
CLEAN = "library museum school university research journal news weather recipes garden history science physics music books travel hospital city council archive forum docs wiki radio theatre nature family bicycle kitchen language market station harbour village painting reading cooking sailing building training hotel planet report letter".split()
BESIDE = "free cheap best win online x top live now city today world house group web".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()  # frequent pairs of letters
FORMS = ("{w}-{b}.example.com", "www.{b}-{w}.example.org", "{w}{n}.example.net", "blog.{w}.example.org", "m.{b}{w}.example.com", "{b}.{w}.example.net", "{w}{b}.example.org", "www.{w}-{b}.example.com", "m.{w}-{b}.example.net", "{b}-{w}-{n}.example.com")
PATHS = ("/{l}/{n}", "/{l}/{n}.html", "/articles/{n}/", "/", "/{l}/about", "/item/{n}")


def labelled_urls(blocked=BLOCKED, clean=CLEAN, beside=BESIDE) -> list[tuple[str, int]]:
    """A small labelled table (URL, 1 to be blocked): every word in every form of host; words beside it, numbers and paths go
    round alike in both classes, and clean hosts of invented names come with them."""
    out = []
    for label, words in ((0, clean), (1, blocked)):
        for i, word in enumerate(words):
            for j, form in enumerate(FORMS):
                at = 7 * i + 3 * j
                fill = {"w": word, "b": beside[at % len(beside)], "n": 17 + 31 * at % 9000, "l": ("en", "de", "fr", "es")[at % 4]}
                out.append((f"http{'s' * (at % 2)}://{form.format(**fill)}{PATHS[at % len(PATHS)].format(**fill)}", label))
    for i in range(5 * len(blocked)):
        name = "".join(PAIRS[(i * (7 + 4 * x) + 11 * x * x) % len(PAIRS)] for x in range(2 + i % 3))
        out.append((f"https://{('www.', 'blog.', 'm.', '')[i % 4]}{name}.example.{('com', 'org', 'net')[i % 3]}{PATHS[i % len(PATHS)].format(n=13 * i, l='en')}", 0))
    return out


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; of rules of one length, block goes before allow."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        top, slash, rest = name.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _features(raw: np.ndarray, off: np.ndarray, bits: int, sizes=(4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of each string; n-grams never cross strings."""
    base = int(off[0])
    text, off = raw[base : int(off[-1])], off - base
    ranges = grams.Ranges(grams.BYTE[text])
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    rows, buckets = [], []
    for n in sizes:
        h = grams.mix(ranges.grams(n) + np.uint64(n))
        inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
        rows.append(owner[: len(h)][inside])
        buckets.append((h[inside] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _marked(host, path) -> tuple[np.ndarray, np.ndarray]:
    """Host and path of each URL as two strings with their ends marked, one after the other."""
    return utf8(pa.array([x for h, p in zip(host, path, strict=True) for x in (f"^{h}$", f"|{p}$")], pa.large_string()))


class UrlModel:
    """Logistic regression on n-gram counts divided by the root of their number, fitted on the non-zero entries only."""

    def __init__(self, labelled, bits: int = 18, steps: int = 1500, rate: float = 4.0, ridge: float = 1e-4):
        self.bits = bits
        y = np.array([label for _, label in labelled], float)
        row, bucket = _features(*_marked(*zip(*(self.parts(u) for u, _ in labelled), strict=True)), bits)
        used, code = np.unique(bucket, return_inverse=True)
        row, n = row // 2, len(y)
        value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[row]
        w, bias = np.zeros(len(used)), 0.0
        for _ in range(steps):
            error = 1 / (1 + np.exp(-(np.bincount(row, w[code] * value, n) + bias))) - y
            w -= rate * (np.bincount(code, error[row] * value, len(used)) / n + ridge * w)
            bias -= rate * error.mean()
        self.weights, self.bias = np.zeros(1 << bits), bias
        self.weights[used] = w

    @staticmethod
    def parts(url: str) -> tuple[str, str]:
        """Host (A-Z lower-cased) and path as `url_parts` has them."""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1] if "://" in url else "")
        return m[1].translate(LOWER), m[2]

    def score(self, host, path) -> np.ndarray:
        n = len(host)
        row, bucket = _features(*_marked(host, path), self.bits)
        total, count = np.bincount(row // 2, self.weights[bucket], n), np.bincount(row // 2, minlength=n)
        return self.bias + total / np.sqrt(np.maximum(1, count))


def url_filter(pages: DataFrame, rules=RULES, labelled=None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict (allow or block) and score, the model's probability of block.

    A rule fits its host and all subdomains if the path starts with its own; the longest wins over the model. A null URL, or
    one without '://', has an empty host and path and is left to the model. Ids may be null or repeated, rows come back as often;
    other columns are ignored. Rules and the labelled table (URL, 0 or 1) are small parameters; of fitting rules of one length
    block goes before allow.
    """
    ship(pages.sparkSession)
    model = UrlModel(labelled_urls() if labelled is None else labelled)
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    schema = f"page_id {parsed.schema['page_id'].dataType.simpleString()}, host string, path string, score double"

    def run(batches):
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            raw = model.score(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-raw)))], names=["page_id", "host", "path", "score"])

    scored = parsed.mapInArrow(run, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"))
