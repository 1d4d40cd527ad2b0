"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one bit string, a bit for each position of each glob, held in as many
64-bit words as it takes.  A canonical URL (host in lower case, then the path) is read byte by byte; one
shift, two table look-ups and three bit operations move every rule at once (Shift-And), and the URLs of a
batch move abreast.  URLs that no rule can still change its mind about are set aside, and the last few,
long ones go on alone with Python's own long integers.  No row meets another, so there is no shuffle.

Globs: ``*`` is any run without a slash, ``**`` any run, ``?`` one character other than a slash, and a
backslash takes the next character as it is.  A glob has to fit the whole URL, case counts in the path.

Which rule wins: rules with a name before those without, then the longer name, then the earlier rule.
The verdict of a URL that none fits is ``default``.

Cases: a null URL and one without ``://`` have an empty host and path, which rules may fit like any other;
URLs of any length are read whole; every row has a verdict, repeated ones the same; an empty table gives
an empty result; an empty list of rules gives the default.  ``keep_allowed`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLASH = ord("/")
#: Bytes of states that move abreast.
_ABREAST = 4 << 20
#: So few URLs are faster one by one.
_FEW = 8


@dataclass(frozen=True)
class Rule:
    """A URL that fits ``glob`` is judged ``verdict``; ``name`` is what the result calls the rule."""

    verdict: str
    glob: str
    name: str | None = None


def escaped(literal: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in literal)


def prefix_rule(verdict: str, name: str) -> list[Rule]:
    """The rule ``host/path``: the host and its subdomains, paths that start with this one."""
    here = escaped(name) + "**"
    return [Rule(verdict, here, name), Rule(verdict, "*." + here, name)]


def host_rule(verdict: str, glob: str) -> list[Rule]:
    """A glob over hosts, for any path or none; without a name."""
    return [Rule(verdict, glob), Rule(verdict, glob + "/**")]


def rules_of(named: Iterable[tuple[str, str]], hosts: Iterable[tuple[str, str]] = ()) -> list[Rule]:
    return [r for v, name in named for r in prefix_rule(v, name)] + [r for v, glob in hosts for r in host_rule(v, glob)]


class Automaton:
    """The masks of a list of rules.  A glob of m bytes and ``?`` has m + 1 states: that before its first, and one
    after each."""

    def __init__(self, globs: list[str]):
        move, stay = [0] * 256, [0] * 256
        start = closed = bit = 0
        self.accept: list[int] = []
        for glob in globs:
            start |= 1 << bit
            loops = set()
            at = 0
            while at < len(glob):
                c = glob[at]
                if c == "*":
                    wide = glob.startswith("**", at)
                    for x in range(256):
                        if wide or x != _SLASH:
                            stay[x] |= 1 << bit
                    if wide:
                        loops.add(bit)
                    at += 1 + wide
                    continue
                if c == "?":
                    bit += 1
                    for x in range(256):
                        if 0x80 <= x < 0xC0:
                            stay[x] |= 1 << bit  # the rest of a character's bytes
                        elif x != _SLASH:
                            move[x] |= 1 << bit
                    at += 1
                    continue
                if c == "\\" and at + 1 < len(glob):
                    at += 1
                for x in glob[at].encode():
                    bit += 1
                    move[x] |= 1 << bit
                at += 1
            self.accept.append(bit)
            if bit in loops:
                closed |= 1 << bit  # once there, always there
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.move_int, self.stay_int, self.open_int = move, stay, (1 << bit) - 1 & ~closed
        self.move, self.stay = (np.stack([self._row(x) for x in masks]) for masks in (move, stay))
        self.start, self.open = self._row(start), self._row(self.open_int)

    def _row(self, mask: int) -> np.ndarray:
        return np.frombuffer(mask.to_bytes(self.words * 8, "little"), np.uint64)

    def _alone(self, state: int, rest: bytes) -> int:
        move, stay, still = self.move_int, self.stay_int, self.open_int
        for c in rest:
            state = state << 1 & move[c] | state & stay[c]
            if not state & still:
                break
        return state

    def states(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The states after each text, as rows of 64-bit words."""
        n = len(offsets) - 1
        final = np.empty((n, self.words), np.uint64)
        rows = np.argsort(-np.diff(offsets), kind="stable")
        left, at = np.diff(offsets)[rows], offsets[:-1][rows]
        now = np.tile(self.start, (n, 1))
        j = 0
        while len(rows):
            going = np.arange(len(rows)) < np.searchsorted(-left, -j, "left")
            if j % 16 == 0:
                going &= (now & self.open).any(1)
            if not going[-1] or j % 16 == 0:
                final[rows[~going]] = now[~going]
                rows, left, at, now = rows[going], left[going], at[going], now[going]
            if len(rows) <= _FEW:
                for r, size, begin, state in zip(rows, left, at, now, strict=True):
                    end = self._alone(int.from_bytes(state.tobytes(), "little"), data[begin + j : begin + size].tobytes())
                    final[r] = self._row(end)
                break
            c = data[at + j]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = shifted & self.move[c] | now & self.stay[c]
            j += 1
        return final


class UrlFilter:
    def __init__(self, rules: list[Rule], default: str = "allow"):
        ranked = sorted(range(len(rules)), key=lambda i: (rules[i].name is not None, len(rules[i].name or ""), -i))
        self.rules, self.default = [rules[i] for i in ranked], default  # a later one overrules those before it
        self.automaton = Automaton([r.glob for r in self.rules])

    def winners(self, texts: pa.Array) -> np.ndarray:
        """Per canonical URL the place of the rule that wins, -1 if none fits."""
        best = np.full(len(texts), -1)
        automaton, at_once = self.automaton, max(64, _ABREAST // (8 * self.automaton.words))
        for first, last, data, offsets in text_slices(texts):
            for lo in range(0, last - first, at_once):
                hi = min(lo + at_once, last - first)
                states = automaton.states(data, offsets[lo : hi + 1])
                seen = np.bitwise_or.reduce(states, axis=0)
                for i, bit in enumerate(automaton.accept):
                    word, place = bit >> 6, np.uint64(bit & 63)
                    if seen[word] >> place & np.uint64(1):
                        best[first + lo : first + hi][(states[:, word] >> place & np.uint64(1)).astype(bool)] = i
        return best

    def judged(self, canonical: Column) -> Column:
        """struct(rule, verdict) of a canonical URL."""
        names = pa.array([r.name for r in self.rules] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in self.rules] + [self.default], pa.string())
        winners = self.winners

        @F.arrow_udf("rule string, verdict string")
        def run(texts: pa.Array) -> pa.Array:
            at = pa.array(winners(texts))
            at = pa.array(np.where(at.to_numpy() < 0, len(names) - 1, at.to_numpy()))
            return pa.StructArray.from_arrays([names.take(at), verdicts.take(at)], names=["rule", "verdict"])

        return run(canonical)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; path: from
    there up to a question mark, hash or the end.  Both empty without ``://``."""
    place = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    host = rest
    for mark in "/?#":
        host = F.substring_index(host, mark, 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    for mark in "?#":
        path = F.substring_index(path, mark, 1)
    return F.translate(host, _UPPER, _LOWER), path


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    host, path = host_and_path(pages[f"`{url}`"])
    parts = pages.select(pages[f"`{key}`"].alias("key"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("judged", UrlFilter(rules, default).judged(F.concat("host", "path")))
    return judged.select(F.col("key").alias(key), "host", "path", "judged.rule", "judged.verdict")


def keep_allowed(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``pages`` that are not blocked, with all their columns."""
    return pages.where(UrlFilter(rules, default).judged(F.concat(*host_and_path(pages[f"`{url}`"])))["verdict"] == "allow")


#: The rules of the registered query: those with a name, and hosts that advertise or gamble.
NAMED = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
HOSTS = [("block", "*casino*"), ("block", "*-bets.*"), ("block", "*ads-track*")]

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS h FROM p),
c AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, split_part(split_part(substr(rest, length(h) + 1), '?', 1), '#', 1) AS path FROM h),
r AS (SELECT *, CASE WHEN suffix('.' || host, '.www.example.com') AND prefix(path, '/en/') THEN 'www.example.com/en/'
                     WHEN suffix('.' || host, '.example.com') AND prefix(path, '/en/') THEN 'example.com/en/'
                     WHEN suffix('.' || host, '.net') AND prefix(path, '/es/') THEN 'net/es/'
                     WHEN suffix('.' || host, '.net') AND prefix(path, '/fr/') THEN 'net/fr/'
                     WHEN suffix('.' || host, '.com') AND prefix(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN contains(host, 'casino') OR contains(host, '-bets.') OR contains(host, 'ads-track') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
