"""URL filters: all glob rules run over each URL at once, as one bit-parallel automaton.

A glob has a bit for each count of its literal characters that have been read. The bits of all globs
are packed into as many 64-bit words as needed. One step of Shift-And moves every bit on by one, with
a carry between words, and keeps those whose literal fits the character; bits at a wildcard stay
where they are. NumPy takes the step for many URLs at a time, once for each distinct canonical URL
of a batch. Rules reach the executors in the closure; there is no shuffle.

Globs: `*` is any run of characters but `/`, `**` any run, `?` one character but `/`. They are held
against `.host` + `path`, so `*.org/fr/**` fits org, its subdomains, and paths that begin with /fr/.

Defined results: null URLs and those without `://` have an empty host and path, fit no rule and get
the verdict `block`; the rule with the longest name wins, the first of equals; where no rule fits,
a URL is blocked if one of the extra globs fits, and allowed otherwise. Repeated rows are all
answered, other columns of the input that aren't in `keep` are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: Globs for URLs that no rule decides: hosts with a label that begins so are blocked.
EXTRA_GLOBS = ("*.spam*", "*.spam*/**", "*.casino*", "*.casino*/**")
#: Character cells of one step matrix.
CELLS = 4_000_000
_END = 256  # stands for no character


class GlobAutomaton:
    """Masks of all globs, packed one after the other into 64-bit words."""

    def __init__(self, globs: Iterable[str]):
        pieces = [list(self._parse(g)) for g in globs]
        bits = sum(len([p for p in ps if isinstance(p, int)]) + 1 for ps in pieces)
        self.words = max(1, -(-bits // 64))
        self.fits = np.zeros((257, self.words), np.uint64)
        self.stays = np.zeros((257, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.stays[_END] = ~np.uint64(0)
        self.finals = []
        any_byte = np.arange(256)
        no_slash = any_byte[any_byte != 47]
        at = 0
        for ps in pieces:
            self._set(self.start, at)
            for p in ps:
                if p == "*" or p == "**":
                    for b in no_slash if p == "*" else any_byte:
                        self._set(self.stays[b], at)
                else:
                    at += 1
                    for b in no_slash if p == -1 else (p,):
                        self._set(self.fits[b], at)
            self.finals.append(at)
            at += 1

    @staticmethod
    def _parse(glob: str) -> Iterator[int | str]:
        data, i = glob.encode(), 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                yield "**"
                i += 2
            elif data[i] == 42:
                yield "*"
                i += 1
            else:
                yield -1 if data[i] == 63 else data[i]
                i += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, strings: list[bytes]) -> np.ndarray:
        """Whether each glob (column) fits each string (row) as a whole."""
        out = np.zeros((len(strings), len(self.finals)), bool)
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(lens, kind="stable")
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * lens[order[end]] <= CELLS:
                end += 1
            rows = order[begin:end]
            out[rows] = self._run([strings[i] for i in rows], lens[rows])
            begin = end
        return out

    def _run(self, strings: list[bytes], lens: np.ndarray) -> np.ndarray:
        width = int(lens.max(initial=0))
        cells = np.full((len(strings), width), _END, np.uint16)
        cells[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
        state = np.repeat(self.start[None], len(strings), 0)
        one, top = np.uint64(1), np.uint64(63)
        for column in cells.T:
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.fits[column]) | (state & self.stays[column])
        finals = np.array(self.finals, np.int64)
        return (state[:, finals // 64] >> (finals % 64).astype(np.uint64)) & one == one


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def rule_glob(host: str, path: str) -> str:
    """The glob of a rule for a host with its subdomains, and for the paths that begin with `path`."""
    return f"*.{host}{path}**"


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    keep: tuple = ("page_id",),
    extra_globs: tuple = EXTRA_GLOBS,
) -> DataFrame:
    """`keep`, `host`, `path`, `rule`, `verdict`, for rules (allow or block, host, path)."""
    globs = [rule_glob(h, p) for _, h, p in rules] + list(extra_globs)
    names = [h + p for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(names[i]))

    def judge(host: str, path: str, fits: np.ndarray) -> tuple[str | None, str]:
        for i in order:
            if fits[i]:
                return names[i], rules[i][0]
        return None, "block" if not host or fits[len(rules) :].any() else "allow"

    def run(batches):
        automaton = GlobAutomaton(globs)
        for batch in batches:
            hosts, paths = (batch.column(n).to_pylist() for n in ("__host", "__path"))
            keys = list(zip(hosts, paths))
            seen = list(dict.fromkeys(keys))
            fits = automaton.match([f".{h}{p}".encode() for h, p in seen])
            verdicts = {k: judge(*k, f) for k, f in zip(seen, fits)}
            made = [verdicts[k] for k in keys]
            columns = [batch.column(i) for i in range(len(keep))] + [
                pa.array(hosts, pa.string()),
                pa.array(paths, pa.string()),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.string()),
            ]
            names_out = [*keep, "host", "path", "rule", "verdict"]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    parts = pages.select(
        *keep, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path")
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    schema = f"{kept}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(run, schema)
