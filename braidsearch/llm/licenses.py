"""License scans by a positional index of rare words.

The templates, short phrases and whole notices, are indexed by their rarest words: how rare a
word is (IDF) is counted over all scanned files. A file looks up its licence words in that index.
Each hit says where a template would begin; the words at the same relative positions then decide.
A phrase needs all of them. A notice, which a file may break up by names and years, needs half of
its indexed words within `DRIFT` words of one beginning, and every mandatory key phrase.

The index is a constant of a few hundred entries, so it goes with the plan; files are never
shuffled, and the one aggregate counts licence words, one row for each word and task.

Defined results: null and empty texts have no words and no labels; files are cut whole; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.llm import words as wd

# Words by which inserted names may move the parts of a notice.
DRIFT = 24
# Rarest words of a notice that are indexed.
INDEXED = 6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  # mandatory phrases; none: the text itself, word by word

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The base phrases.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

# Phrases and notices added to the base, as words.
ADDED = (
    Template("agpl", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("bsd", "bsd license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("isc", "isc license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "released into the public domain"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted provided that the above copyright notice appear in all copies",
        ("permission to use copy modify", "fee is hereby granted"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("source code form is subject to the terms", "mozilla public license"),
    ),
)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({word for template in templates for word in template.words})


def idf(files: DataFrame, templates: tuple[Template, ...], text: str) -> dict[str, float]:
    """How rare each licence word is among all ``files``; never more rows than licence words."""
    known = F.array(*map(F.lit, vocabulary(templates)))
    one = F.explode(F.array_intersect(wd.words(F.col(text)), known))
    counted = files.select(one.alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    found = {row.word: row.df for row in counted.collect()}
    n = files.count()
    return {word: math.log((n + 1) / (found.get(word, 0) + 0.5)) for word in vocabulary(templates)}


def rare_index(template: Template, rarity: dict[str, float]) -> list[tuple[str, int, float]]:
    """The rarest words of a template: (word, position, IDF), rarest first, ties to the first."""
    order = sorted(
        ((word, at, rarity[word]) for at, word in enumerate(template.words)),
        key=lambda entry: (-entry[2], entry[1]),
    )
    return order[: INDEXED if template.keys else 1]


def _array(values: list[str]) -> str:
    return f"array({', '.join(values)})"


def _quoted(values) -> list[str]:
    return ["'" + value.replace("'", "\\'") + "'" for value in values]


def _phrases(indexed: list) -> str:
    """Phrases as an SQL array: label, words, rarest word and its position."""
    return _array(
        [
            f"named_struct('label', '{template.label}', 'words', {_array(_quoted(template.words))}, "
            f"'word', '{index[0][0]}', 'at', {index[0][1]})"
            for template, index in indexed
        ]
    )


def _notices(indexed: list) -> str:
    """Notices as an SQL array: label, mandatory phrases, indexed words with positions and weights."""
    rows = []
    for template, index in indexed:
        total = sum(weight for _, _, weight in index)
        entries = _array(
            [
                f"named_struct('word', '{word}', 'at', {at}, 'weight', {weight / total:.12f}D)"
                for word, at, weight in index
            ]
        )
        keys = _array(_quoted(f" {key} " for key in template.keys))
        rows.append(f"named_struct('label', '{template.label}', 'keys', {keys}, 'index', {entries})")
    return _array(rows)


# Where a phrase p stands whole: it begins where its rarest word says, and all words agree.
PLACES = """
filter(
  transform(filter(hits, h -> h.word = p.word), h -> h.at - p.at),
  b -> b >= 0 and slice(w, b + 1, size(p.words)) = p.words
)"""

# The greatest share of a notice n's indexed rarity that stands near one beginning.
SHARE = """
array_max(transform(
  array_distinct(flatten(transform(
    n.index, e -> transform(filter(hits, h -> h.word = e.word), h -> h.at - e.at)
  ))),
  b -> aggregate(n.index, 0D, (s, e) -> s + if(
    array_contains(slice(w, greatest(b + e.at, 0) + 1, {drift} + 1), e.word), e.weight, 0D
  ))
))"""

# Of the words w of a file that holds a rare word: places of base phrases and other finds.
FOUND = """
transform(
  array(filter(
    transform(w, (x, i) -> if(array_contains({rare}, x), struct(x as word, i as at), null)),
    h -> h is not null
  )),
  hits -> named_struct(
    'base', flatten(transform({base}, p -> transform({places}, b -> struct(p.label as label, b as at)))),
    'added', concat(
      transform(filter({phrases}, p -> size({places}) > 0), p -> struct(p.label as label, 1D as score)),
      filter(
        transform(
          filter({notices}, n -> forall(n.keys, k -> contains(concat(' ', array_join(w, ' '), ' '), k))),
          n -> struct(n.label as label, {share} as score)
        ),
        f -> f.score >= 0.5D
      )
    )
  )
)[0]"""

SEEN = """
if(
  {words} is null,
  named_struct(
    'n_words', {n}, 'base', cast(array() as array<struct<label:string,at:int>>),
    'base_labels', cast(array() as array<string>), 'labels', cast(array() as array<string>), 'score', 0D
  ),
  transform(transform(array({words}), w -> {found}), f -> named_struct(
    'n_words', {n},
    'base', f.base,
    'base_labels', array_sort(array_distinct(f.base.label)),
    'labels', array_sort(array_distinct(concat(f.base.label, f.added.label))),
    'score', if(size(f.base) > 0, 1D, coalesce(array_max(f.added.score), 0D))
  ))[0]
)"""


def scan(
    files: DataFrame,
    base: tuple[Template, ...] = BASE,
    added: tuple[Template, ...] = ADDED,
    text: str = "text",
) -> DataFrame:
    """``files`` with one struct column more, its name the first free of ``license, _license, ...``.

    It holds ``n_words``, ``base`` (label and first word of every place of a base phrase),
    ``base_labels``, ``labels``, and ``score``: 1 for a whole phrase, for a notice the share of
    its indexed rarity that was found.
    """
    templates = base + added
    rarity = idf(files, templates, text)
    indexed = [(template, rare_index(template, rarity)) for template in templates]
    rare = sorted({word for _, index in indexed for word, _, _ in index})
    whole = [entry for entry in indexed[len(base) :] if not entry[0].keys]
    notices = [entry for entry in indexed[len(base) :] if entry[0].keys]
    found = FOUND.format(
        rare=_array(_quoted(rare)),
        base=_phrases(indexed[: len(base)]),
        phrases=_phrases(whole) if whole else f"filter({_phrases(indexed[:1])}, p -> false)",
        notices=_notices(notices) if notices else f"filter({_notices(indexed[:1])}, n -> false)",
        places=PLACES,
        share=SHARE.format(drift=DRIFT),
    )
    name = wd.free_name(files, "license")
    cut, n = wd.free_name(files, "words"), wd.free_name(files, "n_words")
    with_words = files.withColumn(cut, wd.words(F.col(text)))
    # only files that hold a rare word carry their words further
    looked_up = with_words.withColumns(
        {
            n: F.size(cut).cast("bigint"),
            cut: F.when(F.arrays_overlap(F.col(cut), F.array(*map(F.lit, rare))), F.col(cut)),
        }
    )
    seen = SEEN.format(words=f"`{cut}`", n=f"`{n}`", found=found)
    return looked_up.withColumn(name, F.expr(seen)).drop(cut, n)
