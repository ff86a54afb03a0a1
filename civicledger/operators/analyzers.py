"""Words of a text for searching: a light analyzer and the English one with its stop list and Porter2 stems."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from civicledger import fixed_values as fv

WORD_BREAK = r"[^\p{L}\p{N}]+"


# ---- English stems -------------------------------------------------------------------------------

@lru_cache(None)
def _rules(rules: str) -> list[tuple[str, list]]:
    """One step's rules, longest suffix first, with compiled patterns."""
    ways = lambda w: [(region, re.compile(p.lstrip("!")) if p else None, p[:1] == "!", new) for region, p, new in w]
    return [(s, ways(w)) for s, w in sorted(getattr(fv, rules).items(), key=lambda r: -len(r[0]))]


def _apply(w: str, rules: str, r1: int, r2: int) -> str:
    for suffix, ways in _rules(rules):
        if w.endswith(suffix):
            stem = w[:len(w) - len(suffix)]
            for region, pattern, negated, new in ways:
                if len(stem) >= (0, r1, r2)[region] and (pattern is None or bool(pattern.search(stem)) != negated):
                    return stem + new
            return w
    return w


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in fv.ENGLISH_WHOLE_WORDS:
        return fv.ENGLISH_WHOLE_WORDS.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    region = lambda start: m.end() + start if (m := re.search("[aeiouy][^aeiouy]", w[start:])) else len(w)
    r1 = next((len(p) for p in fv.ENGLISH_LONG_PREFIXES if w.startswith(p)), None) or region(0)
    r2 = region(r1)
    w = _apply(w, "ENGLISH_PLURALS", r1, r2)
    if w not in fv.ENGLISH_LEFT_AFTER_PLURALS:
        before, w = w, _apply(w, "ENGLISH_PAST", r1, r2)
        if w != before and not before.endswith(("eed", "eedly")):     # an ending was taken off: mend what it leaves
            mended = _apply(w, "ENGLISH_AFTER_PAST", r1, r2)
            w = mended + "e" if mended == w and r1 >= len(w) and re.search(fv.ENGLISH_SHORT_SYLLABLE, w) else mended
        for rules in ("ENGLISH_FINAL_Y", "ENGLISH_DERIVED", "ENGLISH_SECOND_DERIVED", "ENGLISH_REMOVED", "ENGLISH_FINAL_E"):
            w = _apply(w, rules, r1, r2)
    return w.replace("Y", "y")


def _stemmed(words: pd.Series, stem_of: Callable[[str], str]) -> pd.Series:
    """Each distinct word of a batch is stemmed once."""
    codes, distinct = pd.factorize(words)
    return pd.Series([stem_of(w) for w in distinct], dtype=object).take(codes).reset_index(drop=True)


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    return _stemmed(words, stem)


# ---- light stems ---------------------------------------------------------------------------------

LIGHT_ENDINGS = ("ings", "edly", "ing", "ed", "es", "s")


@lru_cache(1 << 18)
def light_stem(word: str) -> str:
    """A lower-case word without its longest ending that has three letters before it."""
    for ending in LIGHT_ENDINGS:
        if word.endswith(ending):
            before = word[:-len(ending)]
            if len(before) >= 3 and all(unicodedata.category(c)[0] == "L" for c in before[-3:]):
                return before
    return word


@F.pandas_udf(T.StringType())
def light_stems(words: pd.Series) -> pd.Series:
    return _stemmed(words, light_stem)


# ---- analyzers -----------------------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def light_words(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, term): lightly stemmed words; positions count the words that are left."""
    left = F.filter(_words(text), lambda w: ~w.isin(fv.STOP_WORDS))
    each = df.select(F.col(key).alias("key"), F.posexplode(left).alias("pos", "term"))
    return each.select("key", "pos", light_stems("term").alias("term"))


def english_words(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, term): English stems; stop words go but keep their positions, so a phrase with one in
    it asks for the same distance in the text."""
    each = df.select(F.col(key).alias("key"), F.posexplode(_words(text)).alias("pos", "term"))
    return each.filter(~F.col("term").isin(fv.ENGLISH_STOP_WORDS)).select("key", "pos", stems("term").alias("term"))


ANALYZERS = {"light": light_words, "english": english_words}


# ---- packed words --------------------------------------------------------------------------------

class Packing(NamedTuple):
    """What an analyzer does with the words of a text."""
    stem: Callable[[str], str]
    stop: frozenset[str]
    gaps: bool          # stop words keep their positions


PACKINGS = {"light": Packing(light_stem, frozenset(fv.STOP_WORDS), False), "english": Packing(stem, frozenset(fv.ENGLISH_STOP_WORDS), True)}

#: Words that are packed together. A longer text is a run of its own, never cut.
RUN = 1 << 20


def _pack(keys: pa.Array, words: pa.Array, how: Packing) -> list[pa.Array]:
    """Terms of a run of documents with the documents and positions of each, in order."""
    spelled = words.flatten().dictionary_encode()
    codes, forms = spelled.indices.to_numpy(), spelled.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    stopped = np.array([w in how.stop for w in forms], bool)
    counted = (np.array([w != "" for w in forms], bool) & (how.gaps | ~stopped))[codes]
    doc, codes = doc[counted], codes[counted]
    pos = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(keys)))[doc]
    kept = ~stopped[codes]
    doc, codes, pos = doc[kept], codes[kept], pos[kept]
    number = {"": 0}        # no word is empty: this term holds every document
    terms = np.array([0 if w == "" or no else number.setdefault(how.stem(w), len(number)) for w, no in zip(forms, stopped)], np.int64)
    term = terms[codes]
    order = np.argsort(term, kind="stable")
    sizes = np.bincount(term, minlength=len(number))
    sizes[0] = len(keys)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    held = np.concatenate([np.arange(len(keys)), doc[order]])
    pos = np.concatenate([np.zeros(len(keys), np.int64), pos[order]])
    return [pa.array(list(number), pa.string()), pa.ListArray.from_arrays(at, keys.take(pa.array(held))), pa.ListArray.from_arrays(at, pa.array(pos, pa.int32()))]


def packed_words(df: DataFrame, key: str, text: Column, analyzer: str) -> DataFrame:
    """(term, keys, at): the words of an analyzer, a row for each term of a run of documents. ``keys`` and ``at``
    have an entry for each place of the term, so far fewer rows are moved and sorted. The empty term holds
    every document once, those without a word too. Texts are dealt out evenly first: a table in one row
    group would be one task's work."""
    how = PACKINGS[analyzer]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = batch.columns
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64))
            first = 0
            while first < len(keys):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + RUN, "right")))
                yield pa.RecordBatch.from_arrays(_pack(keys[first:last], words[first:last], how), ["term", "keys", "at"])
                first = last

    dealt = df.select(F.col(key).alias("key"), text.alias("text")).repartition("key")
    return dealt.select("key", F.split(F.lower("text"), WORD_BREAK).alias("words")).mapInArrow(pack, schema)
