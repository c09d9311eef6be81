"""Text to sentences of tokens, as column expressions.

Lower-casing, punctuation and digits are handled on the whole text before it is split,
which gives the tokens that word-by-word handling would and keeps the
per-word work to one split a sentence.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"\p{IsWhite_Space}"
#: Ideographs with extensions and compatibility forms, kana, hangul, CJK punctuation, and full-width forms.
CJK = r"[一-鿿㐀-䶿\x{20000}-\x{2A6DF}豈-﫿぀-ゟ゠-ヿ가-힯　-〿＀-￯]"
_KEEP = rf"\p{{IsAlphabetic}}\p{{N}}{SPACE}"

# whole tokens only; a bare suffix expands where it stands alone
_NOT = "are could did does do had has have is should was were would".split()
_IS = "here it that there what where who".split()
CONTRACTIONS = (
    {f"{w}n't": f"{w} not" for w in _NOT}
    | {f"{w}'s": f"{w} is" for w in _IS}
    | {"let's": "let us", "i'm": "i am", "won't": "will not", "can't": "cannot"}
    | {"'" + a: " " + b for a, b in zip(("m", "d", "ll", "ve", "re"), ("am", "would", "will", "have", "are"))}
    | {"n't": " not"}
)
STOP_WORDS = tuple(
    sorted("a an the i me you he him she her it we us they them at by for in of on to with and be been being is are was were can could do did does had has have may might must shall should will would".split())
)


@F.arrow_udf(StringType())
def _nfc(v: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in v.to_pylist()], pa.string())


def nfc(t: Column) -> Column:
    """Unicode normal form C. Texts whose characters all lie below U+0300 are
    in that form and don't go through Python."""
    return F.coalesce(_nfc(F.when(t.rlike(r"[^\x00-˿]"), t)), t)


def strip_html(t: Column) -> Column:
    """Without tags; a tag that doesn't end goes on to the end of the text."""
    return F.replace(F.regexp_replace(t, r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def strip_urls(t: Column) -> Column:
    """Without words that begin like a URL; white space becomes single blanks."""
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: (w != "") & ~w.rlike(r"^(https?://|www\.)"))
    return F.array_join(words, " ")


def expand_contraction(word: Column) -> Column:
    """The long form of a word that is a contraction, or the word as it is."""
    known = F.create_map(*[F.lit(x) for pair in sorted(CONTRACTIONS.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(word)), word)


def has_cjk(t: Column) -> Column:
    return t.rlike(CJK)


def detect_language(t: Column) -> Column:
    """"en" if more than a fifth (rounded down) of the words are English function words, else "unknown"."""
    words = F.filter(F.split(F.lower(t), f"{SPACE}+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))
    return F.when(hits > F.floor(F.size(words) / 5), "en").otherwise("unknown")


@dataclass(frozen=True)
class TextProcessor:
    """What happens to texts. `remove_stop_words`, `normalize_unicode` and
    `language` are accepted and change nothing: normalisation always happens."""

    lowercase: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    remove_stop_words: bool = False
    remove_html: bool = False
    remove_urls: bool = False
    expand_contractions: bool = False
    normalize_unicode: bool = False
    language: str = "en"

    def _chars(self, t: Column, stops: str) -> Column:
        if self.lowercase:
            t = F.lower(t)
        if self.remove_punctuation:
            t = F.regexp_replace(t, f"[^{_KEEP}{stops}]", "")
        if self.remove_numbers:
            t = F.regexp_replace(t, "[0-9]", "")
        return t

    def sentences(self, text: Column) -> Column:
        """ARRAY<ARRAY<STRING>>: the tokens of each sentence that has any.

        With one CJK character the whole text is cut into single characters and
        more marks end a sentence."""
        t = nfc(text)
        if self.remove_html:
            t = strip_html(t)
        if self.remove_urls:
            t = strip_urls(t)
        if self.expand_contractions:
            parts = F.split(t, "[.!?\n]")
            words = F.transform(parts, lambda s: F.flatten(F.transform(F.split(s, f"{SPACE}+"), lambda w: F.split(self._chars(expand_contraction(w), ""), f"{SPACE}+"))))
        else:
            words = F.transform(F.split(self._chars(t, r".!?\n"), "[.!?\n]"), lambda s: F.split(s, f"{SPACE}+"))
        chars = F.transform(F.split(self._chars(t, r".!?\n;。！？"), "[.!?\n;。！？]"), lambda s: F.split(F.regexp_replace(s, SPACE, ""), ""))
        both = F.when(has_cjk(t), chars).otherwise(words)
        return F.filter(F.transform(both, lambda s: F.filter(s, lambda w: w != "")), lambda s: F.size(s) > 0)


def sentences(docs: DataFrame, processor: TextProcessor | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sent_id, words) for every sentence of every document."""
    cut = (processor or TextProcessor()).sentences(F.col(text))
    return docs.select(F.col(key), F.posexplode(cut).alias("sent_id", "words"))


def tokens(docs: DataFrame, processor: TextProcessor | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sent_id, pos, word) for every token."""
    return sentences(docs, processor, text, key).select(key, "sent_id", F.posexplode("words").alias("pos", "word"))
