"""Source code to lines of tokens, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CAMEL = r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[A-Z][a-z])"
LONGEST = 64


def split_camel_case(w: Column) -> Column:
    """Lower-cased parts of an identifier. One of at most two bytes or with
    an underscore stays whole."""
    whole = (F.octet_length(w) <= 2) | w.contains("_")
    return F.when(whole, F.array(F.lower(w))).otherwise(F.transform(F.split(w, _CAMEL), F.lower))


@dataclass(frozen=True)
class CodeProcessor:
    language: str = "rust"
    remove_comments: bool = True
    remove_string_literals: bool = True
    split_camel_case: bool = True
    remove_numbers: bool = True

    def stripped(self, code: Column) -> Column:
        """Code without comments and, if asked for too, string literals. "//"
        begins a comment in every language and "#" in Python alone."""
        if not self.remove_comments:
            return code
        parts = [r"/\*(?:.*?\*/|.*\z)", r"//[^\n]*"] + ([r"#[^\n]*"] if self.language == "python" else [])
        if self.remove_string_literals:
            parts += [rf"{q}(?:\\.|[^{q}\\])*(?:{q}|\\?\z)" for q in "\"'"]
        return F.regexp_replace(code, "(?s)" + "|".join(parts), "")

    def tokens(self, line: Column) -> Column:
        """The tokens of one line."""
        raw = F.regexp_extract_all(line, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))
        if self.split_camel_case:
            raw = F.flatten(F.transform(raw, lambda w: F.when(F.octet_length(w) > 1, split_camel_case(w)).otherwise(F.array(w))))
        return F.filter(raw, lambda w: F.octet_length(w).between(1, LONGEST) & (~w.rlike("^[0-9]+$") if self.remove_numbers else F.lit(True)))

    def sentences(self, code: Column) -> Column:
        """ARRAY<ARRAY<STRING>>: the tokens of each line that has any."""
        lines = F.transform(F.split(self.stripped(code), "\r?\n"), self.tokens)
        return F.filter(lines, lambda s: F.size(s) > 0)


def code_sentences(files: DataFrame, processor: CodeProcessor | None = None, code: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sent_id, words) for every line of code with tokens."""
    cut = (processor or CodeProcessor()).sentences(F.col(code))
    return files.select(F.col(key), F.posexplode(cut).alias("sent_id", "words"))
