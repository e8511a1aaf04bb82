"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of machine words (Shift-And with self-loops for stars); a step by one byte
advances every rule at once. A batch of URLs is advanced together, one byte position at a time, so the inner work is
numpy on (urls, words) arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices

#: (verdict, host, path start): a host rule also holds for subdomains. Fixed values of the query.
PREFIX_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Globs that block a URL which no prefix rule covers: of its host if the glob has no "/" or ".", else of host + path.
#: ``*`` stands for any run, ``^`` for one without "/".
#: Kinds: gambling, pills, adult, pirated, spam and advertising hosts; then paths of forms, carts, feeds, archives and files.
BLOCK_GLOBS = (
    "^casino^", "^free-bets^", "^betting^", "^poker^", "^jackpot^", "^slots^",
    "^cheap-pills^", "^viagra^", "^cialis^", "^pharmacy-online^",
    "^porn^", "^xxx^", "^sexcam^", "^escorts^",
    "^warez^", "^keygen^", "^cracked-apps^", "^torrents^",
    "^spam^", "^ads-track^", "^adserver^", "^adclick^", "^doorway^", "^replica-watches^", "^payday-loan^",
    "*/wp-login.php", "*/wp-admin/*", "*/user/login", "*/cart/*", "*/checkout/*", "*/affiliate/*", "*/out/redirect*", "*/feed/atom*", "*/xmlrpc.php",
    "*.exe", "*.apk", "*.zip", "*.rar", "*.iso", "*.mp4", "*.jpg", "*.png",
)
#: Globs of a file at most: some 20 MB of masks in a task.
MOST_GLOBS = 20_000
COLUMNS = "page_id long, host string, path string, rule string, verdict string"
_PARTS = re.compile(r"(?s)://([^/?#]*)([^?#]*)")


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without "://"."""
    found = _PARTS.search(url or "")
    if not found:
        return "", ""
    return found[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), found[2]


class GlobSet:
    """Many globs as one automaton. ``*``: any bytes; ``^``: any bytes but "/"; a glob covers the whole text.

    A glob that ends in a star accepts as soon as its last byte is read, its bit then stays on by a self-loop.
    """

    def __init__(self, globs: Sequence[str]):
        literal: list[tuple[int, int]] = []  # (bit, byte)
        loops: list[tuple[int, bool]] = []  # (bit, "/" allowed)
        starts: list[int] = []
        self.accept = []
        bit = 0
        for glob in globs:
            starts.append(bit)  # each glob begins with a state "nothing read yet"
            state = bit
            bit += 1
            for c in glob.encode():
                if c in b"*^":
                    loops.append((state, c == ord("*")))
                else:
                    literal.append((bit, c))
                    state = bit
                    bit += 1
            self.accept.append(state)
        words = (bit + 63) // 64
        self.init = np.zeros(words, np.uint64)
        self.step = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        one = np.uint64(1)
        for b in starts:
            self.init[b // 64] |= one << np.uint64(b % 64)
        for b, c in literal:
            self.step[c, b // 64] |= one << np.uint64(b % 64)
        for b, slash in loops:
            self.stay[:, b // 64] |= one << np.uint64(b % 64)
            if not slash:
                self.stay[ord("/"), b // 64] &= ~(one << np.uint64(b % 64))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean for each text and glob."""
        n, words = len(texts), len(self.init)
        state = np.tile(self.init, (n, 1))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        longest = int(lengths.max(initial=0))
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than each position
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        for at in range(longest):
            k = int(live[at])
            byte = flat[begin[:k] + at]
            now = state[:k]
            moved = now << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.step[byte]) | (now & self.stay[byte])
        bits = np.array(self.accept)
        hit = (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(bits)), bool)
        out[order] = hit.astype(bool)
        return out


@lru_cache(maxsize=8)
def _compiled(rules: tuple, blocked: tuple) -> GlobSet:
    globs = []
    for _, host, path in rules:
        globs += [f"{host}{path}*", f"^.{host}{path}*"]
    hosts = [g for g in blocked if "/" not in g and "." not in g]
    return GlobSet([*globs, *(g + "/*" for g in hosts), *blocked])


def judge(urls: Sequence[str | None], rules: tuple = PREFIX_RULES, blocked: tuple = BLOCK_GLOBS) -> list[tuple]:
    """(host, path, rule, verdict) of each URL; the longest matching rule wins, a block among equals."""
    parts = [canonical(u) for u in urls]
    hits = _compiled(rules, blocked).match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
    order = sorted(range(len(rules)), key=lambda r: (-len(rules[r][1] + rules[r][2]), rules[r][0] != "block", r))
    out = []
    for (host, path), hit in zip(parts, hits):
        rule = next((r for r in order if hit[2 * r] or hit[2 * r + 1]), None)
        if rule is not None:
            out.append((host, path, rules[rule][1] + rules[rule][2], rules[rule][0]))
        else:
            out.append((host, path, None, "block" if hit[2 * len(rules) :].any() else "allow"))
    return out


def read_globs(spark: SparkSession, path: str, most: int = MOST_GLOBS) -> tuple[str, ...]:
    """The globs of text files, one a line, for ``blocked``; blank lines, repeats and lines that begin with # are left out.

    Every task holds all of them, so more than ``most`` are refused.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("glob")).where("glob <> '' AND NOT startswith(glob, '#')").distinct()
    found = [r["glob"] for r in lines.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} globs")
    return tuple(sorted(found))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = PREFIX_RULES, blocked: tuple = BLOCK_GLOBS) -> DataFrame:
    """A verdict for each row of ``pages``; only these two columns are read, so others cannot clash.

    A null URL or one without "://" has an empty host and path, no rule, and is allowed; a null id is kept. Repeated rows are
    judged alike. Among rules of equal length a block wins, then the first. A URL of any length is read whole. An empty table
    gives an empty result. No shuffle.
    """

    def run(ids: list, urls: list) -> Iterator[tuple]:
        for i, row in zip(ids, judge(urls, rules, blocked)):
            yield i, *row

    return map_slices(pages.select(id_col, url_col), run, COLUMNS)
