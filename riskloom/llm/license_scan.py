"""License scans: text blocks that hold most of a notice, by an exact set-similarity join.

A notice and a block are sets of words. A block fits when it holds the share `threshold` of a
notice's words. Words of the notices are ordered by the number of documents that hold them, counted
over the whole corpus, rarest first. Of a notice with n words of which k must be met, any fitting
block holds one of the first n-k+1 (prefix filter), has k words at least (length filter), and
from the first word in common on, both sides must have enough words left (positional filter). What
passes is counted, block by block.

The blocks of a notice are all runs of `room` words of the whole text, where a line break only
separates words: as long as the notice with as many other words between its own as the threshold lets
be missing. So a short notice is sought in a sentence, a long one in a page.

A notice that names its licence (`NAMES`) needs the name in the block too, word after word. Where
several names begin at one word, only the longest is there: "CC BY-NC" doesn't name CC BY.

The notices and their word counts are the only thing that is collected and sent to executors: their
size is that of the notices, not of the corpus. There is one small shuffle, of word counts already
summed in each task.

The base labels come from phrases: words that stand one after the other anywhere in the text.

Defined results: null text is empty, with no words, score 0 and empty labels; a text of any length is
read whole, row by row; labels met equally well are all given; repeated rows are all answered; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import plain_words, utf8

#: Phrases of the contract, the label of each.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Well-known notices and full texts of short licences.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "Licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
        "License.",
    ],
}
#: Names of licences; a notice with a name of its label is met with this name only.
NAMES = {
    "mit": ["mit"],
    "apache": ["apache"],
    "gpl": ["general public license"],
    "mpl": ["mozilla public license"],
    "cc-by": ["cc by", "attribution"],
    "cc-by-nc": ["cc by nc", "attribution noncommercial"],
    "cc-by-nd": ["cc by nd", "attribution noderivatives"],
    "cc-by-sa": ["cc by sa", "attribution sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "attribution noncommercial noderivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "attribution noncommercial sharealike"],
}


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    needed: int
    length: int = 0  # in words, repeated ones too
    name: tuple[bytes, ...] = ()  # words that stand one after the other in what is found

    @property
    def room(self) -> int:
        """Words of a passage with the notice and others between, by its share."""
        return -(-max(self.length, len(self.words)) * len(self.words) // self.needed)

    @property
    def prefix(self) -> int:
        return len(self.words) - self.needed + 1


def _vocabulary(notices: dict[str, list[str]]) -> set[bytes]:
    return {w for texts in notices.values() for t in texts for w in plain_words(t.encode())}


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands; all documents are counted."""
    words = sorted(vocabulary)

    def run(batches):
        counts = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(plain_words(value)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(words)), pa.int32()),
                pa.array([counts[w] for w in words], pa.int64()),
            ],
            ["word", "n"],
        )

    counted = docs.select(utf8(text)).mapInArrow(run, "word int, n bigint")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r["word"]]: r["n"] for r in rows}


def prepared(
    notices: dict[str, list[str]],
    counts: dict[bytes, int],
    threshold: float,
    names: dict[str, list[str]] = NAMES,
) -> list[Notice]:
    """Notices as sets in the order of the corpus, rarest word first, each with its longest name."""
    out = []
    for label, texts in notices.items():
        for text in texts:
            all_words = plain_words(text.encode())
            words = sorted(set(all_words), key=lambda w: (counts.get(w, 0), w))
            needed = int(np.ceil(threshold * len(words) - 1e-9))
            own = [tuple(n.encode().split()) for n in names.get(label, ())]
            name = max((n for n in own if _places(all_words, n)), key=len, default=())
            out.append(Notice(label, tuple(words), max(1, needed), len(all_words), name))
    return out


def _places(words: list[bytes], parts: tuple[bytes, ...]) -> list[int]:
    """Every start of the parts, one after the other, among the words."""
    out, at = [], -1
    while True:
        try:
            at = words.index(parts[0], at + 1)
        except ValueError:
            return out
        if tuple(words[at : at + len(parts)]) == parts:
            out.append(at)


class Scanner:
    """Notices against the blocks of a text."""

    def __init__(
        self,
        notices: list[Notice],
        counts: dict[bytes, int],
        names: dict[str, list[str]] = NAMES,
    ):
        self.notices = notices
        words = {w for n in notices for w in n.words}
        order = sorted(words, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.by_word: dict[bytes, list[int]] = {}
        for i, notice in enumerate(notices):
            for word in notice.words[: notice.prefix]:
                self.by_word.setdefault(word, []).append(i)
        self.sets = [frozenset(n.words) for n in notices]
        self.prefixes = frozenset(self.by_word)
        own = {tuple(n.encode().split()) for texts in names.values() for n in texts}
        self.names = sorted(own | {n.name for n in notices if n.name}, key=len, reverse=True)

    def named(self, words: list[bytes]) -> dict[tuple[bytes, ...], list[int]]:
        """Starts of each name; of names that begin at one word, the longest only."""
        out, taken = {}, set()
        for name in self.names:
            starts = [at for at in _places(words, name) if at not in taken]
            taken.update(starts)
            out[name] = starts
        return out

    def scan(self, words: list[bytes]) -> dict[int, float]:
        """The greatest share of each notice that a fitting block of the text's words holds."""
        held = self.rank.keys() & words
        asked = {i for w in self.prefixes & held for i in self.by_word[w]}
        asked = {i for i in asked if len(self.sets[i] & held) >= self.notices[i].needed}
        if not asked:
            return {}
        names = self.named(words) if any(self.notices[i].name for i in asked) else {}
        asked = {i for i in asked if not self.notices[i].name or names[self.notices[i].name]}
        if not asked:
            return {}
        wanted = frozenset().union(*(self.sets[i] for i in asked))
        places = [(at, w) for at, w in enumerate(words) if w in wanted]
        found = {}
        for i in sorted(asked):
            notice, own = self.notices[i], self.sets[i]
            common = self._most(notice, [p for p in places if p[1] in own], names.get(notice.name))
            if common:
                found[i] = common / len(notice.words)
        return found

    def _most(self, notice: Notice, places: list, starts: list[int] | None) -> int:
        """The most words of the notice that a block holds, 0 if none fits."""
        prefix = frozenset(notice.words[: notice.prefix])
        best = 0
        for a, b in self._regions(notice, places, prefix):
            held = {w for _, w in places[a:b]}
            rarest = min(held, key=self.rank.__getitem__)
            left = len(notice.words) - notice.words.index(rarest)
            if min(len(held), left) <= max(best, notice.needed - 1):
                continue
            counts: Counter = Counter()
            first = a
            for at, word in places[a:b]:
                counts[word] += 1
                while places[first][0] <= at - notice.room:
                    gone = places[first][1]
                    counts[gone] -= 1
                    if not counts[gone]:
                        del counts[gone]
                    first += 1
                if len(counts) > best and len(counts) >= notice.needed:
                    if starts is not None:
                        # Words of a name are words of the notice, so it lies between first and last.
                        next_name = bisect_left(starts, places[first][0])
                        if next_name == len(starts):
                            continue
                        if starts[next_name] + len(notice.name) > at + 1:
                            continue
                    best = len(counts)
        return best

    @staticmethod
    def _regions(notice: Notice, places: list, prefix: frozenset):
        """Runs of places that a block around a word of the prefix may reach."""
        begin = end = reach = 0
        for i, (at, word) in enumerate(places):
            if word not in prefix:
                continue
            low = bisect_left(places, (at - notice.room + 1,))
            high = bisect_left(places, (at + notice.room,))
            if low > reach and end:
                yield begin, end
                begin = low
            elif not end:
                begin = low
            end = reach = high
        if end:
            yield begin, end


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand one after the other."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        last, at = parts[-1], len(parts) - 2
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            begin = at - len(parts) + 1
            if words[begin : at + 1] == parts:
                out.append((begin, label))
    return out


def scan(
    docs: DataFrame,
    text: str = "text",
    keep: tuple = ("doc_id",),
    notices: dict[str, list[str]] = NOTICES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.8,
    names: dict[str, list[str]] = NAMES,
) -> DataFrame:
    """`keep`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    The score is the greatest share of a notice that a block holds, if a block fits, and 1 where a
    phrase stands.
    """
    vocabulary = _vocabulary(notices)
    counts = word_counts(docs, vocabulary, text)
    sets = prepared(notices, counts, threshold, names)
    lasts = frozenset(p.encode().split()[-1] for p in phrases)
    kept = docs.select(*keep).schema

    def run(batches):
        scanner = Scanner(sets, counts, names)
        for batch in batches:
            out = []
            for value in batch.column(len(keep)).to_pylist():
                words = plain_words(value)
                places = []
                if not lasts.isdisjoint(words):
                    places = phrase_places(words, phrases)
                found = {}
                if not scanner.prefixes.isdisjoint(words):
                    found = scanner.scan(words)
                base = {label for _, label in places}
                more = base | {scanner.notices[i].label for i in found}
                out.append(
                    {
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min(places)[0] if places else None,
                        "last_word": max(places)[0] if places else None,
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(more)),
                        "score": 1.0 if places else max(found.values(), default=0.0),
                    }
                )
            made = pa.RecordBatch.from_pylist(out, schema=_MADE)
            left = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*left, *made.columns], [*keep, *_MADE.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*keep, utf8(text)).mapInArrow(
        run,
        schema + ", n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double",
    )


_MADE = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
    ]
)
