"""Terms and phrases: phrases within texts, normal forms, candidate terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import BROADCAST_BYTES, found_phrases


def phrases_in_texts(texts: DataFrame, doc: str, text: str, phrases: DataFrame, phrase: str, cap: int) -> DataFrame:
    """Phrases that stand in a text as whole words: doc, phrase, place; the longest first, at most cap.

    Words are parted by single spaces; phrases with other blanks do not occur. Phrases up to a stated size go over the texts as one automaton; of more phrases each
    meets texts by its rarest word only, then is looked for as a whole.
    """
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(F.length(phrase)), phrase))
    size = phrases.agg(F.coalesce(F.sum(F.length(phrase) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        few = [r[0] for r in phrases.select(phrase).filter(~F.col(phrase).rlike("^ |  | $|^$")).distinct().collect()]
        found = found_phrases(texts, doc, text, few).withColumnRenamed("phrase", phrase)
        return found.withColumn("place", place).filter(F.col("place") <= cap)
    phrases = phrases.filter(~F.col(phrase).rlike("^ |  | $|^$"))
    words = texts.select(doc, F.explode(F.array_distinct(F.split(text, " "))).alias("_word"))
    wanted = phrases.select(phrase, F.explode(F.array_distinct(F.split(phrase, " "))).alias("_word"))
    counts = words.join(wanted.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = wanted.join(counts, "_word").groupBy(phrase).agg(F.min(F.struct("_n", "_word")).alias("_r")).select(phrase, F.col("_r._word").alias("_word"))
    met = words.join(rarest, "_word").join(texts.select(doc, F.concat(F.lit(" "), text, F.lit(" ")).alias("_text")), doc)
    found = met.filter(F.contains("_text", F.concat(F.lit(" "), phrase, F.lit(" ")))).select(doc, phrase).distinct()
    return found.withColumn("place", place).filter(F.col("place") <= cap)


#: Letters and digits of one script written in several ways, and their common form.
_FROM, _TO = "يكأإآۀة۰۱۲۳۴۵۶۷۸۹", "یکاااهه0123456789"


def normalised(text: Column) -> Column:
    """Lower case, one form of letters and digits; vowel signs, joiners and runs of white space become a single space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), "[\\u064B-\\u0652\\u200C\\s]+", " "))


def number_form(text: Column) -> Column:
    """Part numbers in upper case without hyphens and blanks; ten characters are written 5-5."""
    plain = F.upper(F.regexp_replace(text, "[- ]", ""))
    return F.when(F.length(plain) == 10, F.concat(F.substring(plain, 1, 5), F.lit("-"), F.substring(plain, 6, 5))).otherwise(plain)


def candidate_terms(rows: DataFrame, term: str) -> DataFrame:
    """Terms without bracketed parts and leading trouble code, of 3 to 80 characters, with 3 letters, and no mere stop word."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(term, "\\[[^\\]]*\\]", ""), "^P[0-9]{4}\\s*", ""))
    letters = F.length(F.regexp_replace(term, "[^A-Za-z]", ""))
    return rows.withColumn(term, plain).filter(F.length(term).between(3, 80) & (letters >= 3) & ~F.lower(term).isin("the", "and", "other"))


def variant_fit(other_engine: Column, other_years: Column) -> Column:
    """How well a vehicle's variant fits: 0.8 for another kind of engine times 0.85 for other years."""
    return F.when(other_engine, 0.8).otherwise(1.0) * F.when(other_years, 0.85).otherwise(1.0)
