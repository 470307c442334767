"""Licence scan by a positional rare-token index.

The index posts every template word with its templates and offsets, and the words' IDF over all files. A file looks up its
licence words in falling order of IDF: of each template whose key words it has, the two rarest (``RARE``) give two sets of
places, moved by their offsets; where these agree, the whole key phrase is verified. The template's other words are then looked
for within ``SHIFT`` words of their place, so a word put in or left out moves a match but does not break it.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import letter_words, need, replacing, small_batches, with_fields
from .decontam import word_counts


class Template(NamedTuple):
    """``words`` of the template; the ``key`` words from offset ``at`` on must all stand there."""

    label: str
    words: tuple[bytes, ...]
    at: int
    key: tuple[bytes, ...]


def template(label: str, text: str, key: str | None = None) -> Template:
    words, part = tuple(text.encode().split()), tuple((key or text).encode().split())
    at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
    return Template(label, words, at, part)


#: Base phrases and their labels.
BASE = (template("cc-by", "cc by"), template("gpl", "general public license"), template("reserved", "all rights reserved"))

#: Further templates: notice sentences of common licences, with the phrase that must stand there.
MORE = (
    template("mit", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("apache", "licensed under the apache license version 2 0", "apache license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("bsd", "bsd license"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("cc0", "creative commons zero"),
)


#: Key words of a template that a file's places are intersected over, and how far another word may stand from its place.
RARE, SHIFT = 2, 2


class Index(NamedTuple):
    """``postings``: licence word to (template number, offset in the template, whether in its key phrase); ``order``: words
    from the highest IDF to the lowest; ``keys``: distinct key words of each template."""

    templates: tuple[Template, ...]
    postings: dict[bytes, list[tuple[int, int, bool]]]
    order: dict[bytes, int]
    keys: tuple[frozenset[bytes], ...]


def build_index(templates: tuple[Template, ...], counts: dict[bytes, int]) -> Index:
    postings: dict[bytes, list[tuple[int, int, bool]]] = {}
    for t, one in enumerate(templates):
        for i, w in enumerate(one.words):
            postings.setdefault(w, []).append((t, i, one.at <= i < one.at + len(one.key)))
    order = {w: k for k, w in enumerate(sorted(postings, key=lambda w: (counts.get(w, 0), w)))}
    return Index(templates, postings, order, tuple(frozenset(x.key) for x in templates))


def placed(where: dict[bytes, list[int]], index: Index) -> dict[int, set[int]]:
    """Per template the places (of its first word) at which its rarest key words of this file agree."""
    possible = {t for t, keys in enumerate(index.keys) if keys <= where.keys()}
    starts: dict[int, set[int]] = {}
    used = dict.fromkeys(possible, 0)
    for word in sorted(where, key=index.order.__getitem__):
        for t, offset, mandatory in index.postings[word]:
            if mandatory and t in possible and used[t] < RARE:
                here = {p - offset for p in where[word]}
                starts[t] = starts[t] & here if used[t] else here
                used[t] += 1
    return starts


def found_templates(words: list[bytes], index: Index) -> Iterator[tuple[int, int, float]]:
    """(template number, word where its key starts, share of the template's words that stand near their place)."""
    where: dict[bytes, list[int]] = {}
    for p, w in enumerate(words):
        if w in index.postings:
            where.setdefault(w, []).append(p)
    for t, starts in placed(where, index).items():
        one = index.templates[t]
        for start in starts:
            key = start + one.at
            if key >= 0 and tuple(words[key:key + len(one.key)]) == one.key:
                near = sum(w in words[max(0, start + i - SHIFT):max(0, start + i + SHIFT + 1)] for i, w in enumerate(one.words))
                yield t, key, near / len(one.words)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """The rows with ``n_words`` and ``found``: (label, template, word, share) of every place, in order of place.

    Document frequencies of the licence words come from all documents; only they decide which words are looked up, the
    places found are the same for any frequencies. Null texts have no words; repeated rows stay; columns of the added names are replaced.
    """
    need(docs, text)
    docs = replacing(docs, "n_words", "found")
    small_batches(docs)
    index = build_index(templates, word_counts(docs, {w for t in templates for w in t.words}, text))
    kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for body in batch.column(text):
                body = body.as_py()
                words = letter_words(body.encode() if isinstance(body, str) else body)
                n_words.append(len(words))
                found.append([{"label": index.templates[t].label, "template": t, "word": k, "share": s}
                              for t, k, s in sorted(found_templates(words, index), key=lambda x: (x[1], x[0]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(found, kind)],
                                             names=[*batch.schema.names, "n_words", "found"])

    place = T.StructType().add("label", T.StringType()).add("template", T.IntegerType()).add("word", T.LongType()).add("share", T.DoubleType())
    return docs.mapInArrow(run, with_fields(docs, n_words=T.LongType(), found=T.ArrayType(place)))
