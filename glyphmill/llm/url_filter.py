"""URL filter by character language models of accepted and rejected URLs.

Two smoothed variable-order Markov models are fitted on seed URLs; a URL is rejected where its
length-normalised log-likelihood difference exceeds a threshold calibrated on held-out seeds.

Seeds come from a table of labelled URLs, or are labelled by a short category list of words in host
names. Of seeds that the list labels, the models never see the words: each is swapped for a name out of
an accepted host, so that only what stands around it can tell the classes apart (how such hosts are put
together, their paths and endings). A URL is thereby judged by its shape; one with a listed word may be
accepted and one without be rejected.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .charlm import RatioModel, best_threshold
from .shared import only
from .textutil import text_steps

SCHEMA = "page_id bigint, url string, llr double, is_rejected boolean"
#: Words of host names by which seeds are labelled where no labels are given: categories of the usual kind.
REJECT_WORDS = ("spam", "casino", "pills", "adult", "porn", "xxx", "bets", "betting", "poker", "viagra", "ads", "track", "warez", "malware", "phish")
_HOST = re.compile(rb"^([a-z][a-z0-9+.-]*://)([^/?#]*)")
_COMMON = frozenset((b"www", b"blog", b"m", b"example", b"com", b"net", b"org"))


def host_pattern(words: tuple[str, ...] = REJECT_WORDS) -> str:
    """Matches a URL whose host has one of the words between dots or hyphens."""
    return r"^[a-z][a-z0-9+.-]*://([^/?#]*[.@-])?(" + "|".join(map(re.escape, words)) + r")[.-]"


def clean_url(text: str | None) -> bytes:
    """The URL in lower case without fragment and surrounding white space; no URL gives b''."""
    if text is None:
        return b""
    return text.strip().split("#", 1)[0].lower().encode("utf-8", "surrogatepass")


def without_words(url: bytes, words: tuple[str, ...], names: list[bytes]) -> bytes:
    """The URL with each listed word of its host swapped for a name, chosen by the URL's checksum."""
    found = _HOST.match(url)
    if not found or not names:
        return url
    turn = zlib.crc32(url)
    swap = lambda m: names[(turn + m.start()) % len(names)]
    host = re.sub(rb"(?<![^.@-])(?:" + b"|".join(re.escape(w.encode()) for w in words) + rb")(?![^.-])", swap, found[2])
    return found[1] + host + url[found.end() :]


def host_names(urls: list[bytes]) -> list[bytes]:
    """The distinct names that the hosts of these URLs are made of."""
    hosts = (m[2] for u in urls if (m := _HOST.match(u)))
    return sorted({n for h in hosts for n in re.split(rb"[.@:-]", h) if n and not n.isdigit()} - _COMMON)


def fit(rejected: list[bytes], accepted: list[bytes], order: int = 5, min_context: int = 2, held_out: int = 5) -> tuple[RatioModel, float]:
    """Models from all but every held_out-th seed, and the threshold from those that are held out."""
    train = [[x for i, x in enumerate(v) if i % held_out != held_out - 1] for v in (rejected, accepted)]
    test = [v[held_out - 1 :: held_out] for v in (rejected, accepted)]
    model = RatioModel(order, "witten_bell", min_context).fit(*train)
    y = np.array([True] * len(test[0]) + [False] * len(test[1]))
    return model, best_threshold(model.score(test[0] + test[1]), y)


def seeds(pages: DataFrame, labels: DataFrame | None, words: tuple[str, ...], per_class: int) -> tuple[list[bytes], list[bytes]]:
    """(rejected, accepted) seed URLs, at most per_class distinct ones of each, in order of a hash."""
    if labels is None:
        urls = only(pages, "url").withColumn("bad", F.lower("url").rlike(host_pattern(words)))
    else:
        urls = only(labels, "url", "rejected").select("url", F.col("rejected").cast("boolean").alias("bad"))
    # a URL with contradicting labels counts as rejected
    urls = urls.filter(F.col("url").rlike(r"\S")).groupBy("url").agg(F.max("bad").alias("bad"))
    kinds = []
    for bad in (True, False):
        part = urls.filter(F.col("bad") == bad).orderBy(F.xxhash64("url"), "url").limit(per_class)
        kinds.append([clean_url(r.url) for r in part.collect()])  # bounded by per_class
    if labels is None:
        names = host_names(kinds[1])
        kinds[0] = [without_words(u, words, names) for u in kinds[0]]
    return kinds[0], kinds[1]


def score_urls(pages: DataFrame, labels: DataFrame | None = None, words: tuple[str, ...] = REJECT_WORDS, order: int = 5, per_class: int = 5000, seed_pages: DataFrame | None = None) -> DataFrame:
    """(page_id, url, llr, is_rejected) for every row of pages.

    labels (url, rejected) has the seeds; without it they are the URLs of seed_pages, or else of pages,
    labelled by `words`; a host of the rejected make that the list misses counts as accepted there. At most
    per_class of each kind are fitted on. A NULL or blank URL has llr NULL and is rejected (there is
    nothing to fetch). A score equal to the threshold is accepted. Where seeds of one kind are missing, as
    in an empty table, llr is NULL and only blank URLs are rejected. Repeated rows are scored one by one,
    with equal scores; a URL of any length is scored whole; NULL ids are carried; columns other than
    page_id and url are ignored.
    """
    kinds = seeds(seed_pages or pages, labels, words, per_class)
    held = pages.sparkSession.sparkContext.broadcast(fit(*kinds, order=order) if all(kinds) else None)

    def run(batches):
        for batch in batches:
            for a, b, texts in text_steps(batch, "url", 1_000_000):
                data = [clean_url(u) for u in texts]
                blank = np.array([not u for u in data], dtype=bool)
                scores, threshold = np.full(len(data), np.nan), 0.0
                if held.value is not None:
                    model, threshold = held.value
                    scores = model.score(data)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(scores, mask=np.isnan(scores)), pa.array(blank | (scores > threshold))],
                    names=["page_id", "url", "llr", "is_rejected"],
                )

    return only(pages, "page_id", "url").withColumn("page_id", F.col("page_id").cast("bigint")).mapInArrow(run, SCHEMA)
