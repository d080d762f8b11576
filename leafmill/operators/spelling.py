"""Spelling: dictionary words within two edits of a token, by deletion keys and a join.

Two words within d edits share a word that is left when at most d letters are deleted from each.  So tokens and dictionary
words meet by an equi-join on such keys, and only pairs that meet are measured.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import cut, table

C = F.col
#: Edits within which a word is looked for.
EDITS = 2


def osa(a: str, b: str, most: int = EDITS) -> int:
    """Edits (insert, delete, replace, swap of neighbours, no letter touched twice) between two words; most + 1 for more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def _fewer(words: Column) -> Column:
    """All words with one letter less."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))))


def keys(word: Column, edits: int = EDITS) -> Column:
    """The word and what is left of it without up to ``edits`` letters."""
    got = now = F.array(word)
    for _ in range(edits):
        now = _fewer(F.filter(now, lambda w: F.length(w) > 0))
        got = F.concat(got, now)
    return F.array_distinct(got)


def suggestions(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """(token, term, distance): of each distinct token the nearest dictionary word (word, count), the most frequent and then
    the alphabetically first on ties.  Tokens without a word within EDITS are left out, null and empty ones too.

    A token that is a dictionary word is its own suggestion and needs no keys.  One longer than the longest dictionary word
    by more than EDITS can have none, so keys stay as short as the dictionary's words.
    """
    words = dictionary.groupBy(C("word")).agg(F.max("count").alias("count")).where("word <> ''")
    t = tokens.select(C(token).alias("token")).where("token <> ''").distinct()
    exact = t.join(words.select(C("word").alias("token")), "token", "left_semi").select("token", C("token").alias("term"), F.lit(0).alias("distance"))
    # a row: the length beyond which no token can have a word
    longest = words.agg((F.coalesce(F.max(F.length("word")), F.lit(0)) + EDITS).alias("most"))
    rest = t.join(words.select(C("word").alias("token")), "token", "left_anti").join(F.broadcast(longest), F.length("token") <= C("most")).select("token", F.explode(keys(C("token"))).alias("k"))
    near = words.select("word", "count", F.explode(keys(C("word"))).alias("k"))

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="int32")

    pairs = rest.join(near, "k").select("token", "word", "count").distinct().where(F.abs(F.length("token") - F.length("word")) <= EDITS)
    measured = pairs.withColumn("d", distance("token", "word")).where(C("d") <= EDITS)
    best = measured.groupBy("token").agg(F.min(F.struct("d", (-C("count")).alias("n"), "word")).alias("b")).select("token", C("b.word").alias("term"), C("b.d").alias("distance"))
    return exact.unionByName(best)


def capitalize(w: Column) -> Column:
    """First letter large, the rest small."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def correct(texts: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """key and the text with every looked-up token replaced by its suggestion, joined by single blanks.

    Numbers and words in capitals stay; a suggestion is capitalized where the token was.  Null stays null, a blank text is ''.
    Only distinct tokens are looked up, and only words that change are gathered by text; the text itself meets its changes in
    one join.  Keys must be unique.
    """
    w = texts.select(key, F.posexplode(T.words(text)).alias("pos", "w")).withColumn("c", T.token_class(C("w"))).where(C("c").isin("plain", "capital")).withColumn("token", F.lower("w"))
    # a dictionary word changes only where capitals stand inside it
    odd = (C("w") != C("token")) & (C("w") != capitalize(C("w")))
    tokens = cut(w.groupBy("token").agg(F.max(odd).alias("odd")))
    change = cut(suggestions(tokens, dictionary).join(tokens, "token").where((C("term") != C("token")) | C("odd")).select("token", "term"))
    new = w.join(change, "token").withColumn("n", F.when(C("c") == "capital", capitalize(C("term"))).otherwise(C("term"))).where(C("n") != C("w"))
    by_text = new.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("_new"))
    joined = texts.select(key, text).join(by_text, key, "left")
    old = T.words(text)
    mixed = F.transform(old, lambda x, i: F.coalesce(F.try_element_at("_new", i), x))
    return joined.select(key, F.when(C(text).isNull(), None).otherwise(F.array_join(F.when(C("_new").isNull(), old).otherwise(mixed), " ")).alias("corrected"))


# --- queries -------------------------------------------------------------------------------------------------------


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """(word, count): words of letters that occur at least ten times in the documents."""
    w = table(spark, d, "documents").select(F.explode(T.words("text")).alias("w")).select(F.lower("w").alias("word")).where(r"word rlike '^\\p{L}{2,}$'")
    return w.groupBy("word").agg(F.count("*").alias("count")).where("count >= 10")


def spell_correct(spark, d):
    """Every recognised text corrected, by hash."""
    o = table(spark, d, "ocr_results").select("ocr_id", "text").dropDuplicates(["ocr_id"])
    return correct(o, dictionary(spark, d), "ocr_id", "text").select("ocr_id", F.md5("corrected").alias("corrected"))


def spell_suggestions(spark, d):
    """Suggestions of all tokens of recognised text, by distance."""
    w = table(spark, d, "ocr_results").select(F.explode(T.words("text")).alias("w")).where(T.token_class(C("w")).isin("plain", "capital")).select(F.lower("w").alias("token"))
    return suggestions(w, dictionary(spark, d))


QUERIES = {"spell_correct": spell_correct, "spell_suggestions": spell_suggestions}
SQL: dict[str, str] = {}
