"""Bloom filters as tables of 64-bit words, for anti-joins of many rows against few keys.

All bits of a key lie in one word, so the filter is a grouped ``bit_or`` (combined before the
shuffle) and a test is one look-up in a broadcast table.  Spark's own runtime filters serve inner
and semi joins only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Bits set for a key, and bits of the filter for each key at least: 3 keys in 100 pass in error, or fewer.
PROBES, BITS_PER_KEY = 4, 16
#: Words of a filter at most: about 40 MB when broadcast.
MOST_WORDS = 1 << 20


def _word(keys: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words))


def _mask(keys: list[str]) -> Column:
    """The key's bits, six bits of a second hash for each."""
    drawn = F.xxhash64(F.lit("bits"), *keys)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(drawn, 6 * n).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), (bit(n) for n in range(PROBES)))


def words_for(n_keys: int) -> int:
    return max(1, 1 << max(0, n_keys * BITS_PER_KEY // 64 - 1).bit_length())


def build(known: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(_word, _bits): the words of the filter of ``known`` that have bits; keys with a null match nothing and set none."""
    return known.dropna(subset=keys).select(_word(keys, words).alias("_word"), _mask(keys).alias("_m")).groupBy("_word").agg(F.bit_or("_m").alias("_bits"))


def _free(name: str, taken: list[str]) -> str:
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def possible(rows: DataFrame, keys: list[str], built: DataFrame, words: int, flag: str = "_possible") -> DataFrame:
    """``rows`` with ``flag``: false only where the key is surely not among those known."""
    word, bits = _free("_word", rows.columns), _free("_bits", rows.columns)
    probed = rows.withColumn(word, _word(keys, words)).join(F.broadcast(built.toDF(word, bits)), word, "left")
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    hit = F.col(bits).bitwiseAND(_mask(keys)) == _mask(keys)
    return probed.withColumn(flag, F.coalesce(whole & hit, F.lit(False))).drop(word, bits)


def anti_join(rows: DataFrame, known: DataFrame, keys: list[str], most_words: int = MOST_WORDS, words: int | None = None) -> DataFrame:
    """``rows`` whose key isn't in ``known``, exactly.

    Only possible hits are shuffled to the exact anti-join; the others, and those with a null in
    their key, go past it.  ``rows`` is read twice, once for each way.  Where the keys would need
    more than ``most_words`` words all rows take the exact join.  ``words`` sets the filter's size.
    """
    known = known.select(*keys)
    words = words or words_for(known.count())
    if words > most_words:
        return rows.join(known, keys, "left_anti").select(*rows.columns)
    flag = _free("_possible", rows.columns)
    probed = possible(rows, keys, build(known, keys, words), words, flag)
    passed, doubtful = (probed.where(w).select(*rows.columns) for w in (~F.col(flag), F.col(flag)))
    return passed.unionByName(doubtful.join(known, keys, "left_anti").select(*rows.columns))
