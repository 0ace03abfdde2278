"""Scalar operators as column expressions. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .words import FRAME_CODES, SIMILARITY_STOP_WORDS

_Col = Column | str


def col(c: _Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text


def strip_verb_sense(verb: _Col) -> Column:
    """Without the sense at its end: _, perhaps a minus, digits."""
    return F.regexp_replace(col(verb), r"_-?[0-9]+$", "")


def verb_stem(verb: _Col) -> Column:
    """What stands before the first underscore."""
    return F.split_part(col(verb), F.lit("_"), F.lit(1))


def strip_negation(verb: _Col) -> Column:
    return F.regexp_replace(col(verb), "^!", "")


def span_of(text: _Col, sentence: _Col) -> Column:
    """struct(start, end) of the first place of sentence in text, from 0, end excluded; null if it has none."""
    at = F.position(col(sentence), col(text))
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.char_length(col(sentence))).cast("int").alias("end")))


def causal_event(v1: _Col, o1: _Col, v2: _Col, o2: _Col) -> Column:
    return F.format_string("((%s, %s), CAUSAL, (%s, %s))", verb_stem(v1), col(o1), verb_stem(v2), col(o2))


def frame_name(code: _Col) -> Column:
    """Name of a frame code, null for unknown ones."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in FRAME_CODES.items() for x in kv]), col(code))


def thinking(response: _Col) -> Column:
    """What a model thought: inside its first <think>…</think>; empty if there is none."""
    return F.trim(F.regexp_extract(col(response), r"(?s)<think>(.*?)</think>", 1))


def answer(response: _Col) -> Column:
    """A model's response without its first thinking section, wherever that occurs."""
    r = col(response)
    section = F.regexp_extract(r, r"(?s)<think>.*?</think>", 0)
    return F.trim(F.when(section != "", F.replace(r, section, F.lit(""))).otherwise(r))


def valid_json(text: _Col, schema: str, enums: dict[str, list[str]] | None = None, required: list[str] | None = None) -> Column:
    """A model's JSON as a struct; null if it can't be read, lacks a required field or has a value outside an enum.

    enums: field path, or "array[].field", to its values.
    """
    s = F.from_json(col(text), schema, {"mode": "PERMISSIVE"})
    ok = s.isNotNull()
    for name in required or []:
        ok = ok & s[name].isNotNull()
    for path, values in (enums or {}).items():
        if "[]." in path:
            array, name = path.split("[].")
            ok = ok & s[array].isNotNull() & F.forall(s[array], _one_of(name, values))
        else:
            ok = ok & F.coalesce(s[path].isin(values), F.lit(False))
    return F.when(ok, s)


def _one_of(name: str, values: list[str]):
    return lambda x: F.coalesce(x[name].isin(values), F.lit(False))


def words_of(text: _Col) -> Column:
    """Lower-cased words between white space, as Python's split gives them for ASCII white space."""
    return F.filter(F.split(F.lower(col(text)), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")


def content_words(text: _Col) -> Column:
    """Distinct words without stop words and single characters."""
    stop = F.array(*map(F.lit, SIMILARITY_STOP_WORDS))
    return F.filter(F.array_except(words_of(text), stop), lambda w: F.char_length(w) > 1)  # array_except drops repeats, too


def set_jaccard(a: _Col, b: _Col) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def jaccard_words(a: _Col, b: _Col) -> Column:
    return set_jaccard(content_words(a), content_words(b))


def masked(tokens: _Col, i: _Col, mask: str = "[MASK]") -> Column:
    """The sentence with token i (from 0) replaced."""
    return F.concat_ws(" ", F.transform(col(tokens), lambda t, k: F.when(k == col(i), mask).otherwise(t)))


# Numbers and vectors


def finite(x: _Col) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    x = col(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def dot(a: _Col, b: _Col) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: _Col) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: _Col, b: _Col, *, zero: float | None = None) -> Column:
    """Null for a vector of norm 0, or zero if that is given."""
    n = norm(a) * norm(b)
    c = F.when(n > 0, dot(a, b) / n)
    return c if zero is None else F.coalesce(c, F.lit(zero))


def squared_distance(a: _Col, b: _Col) -> Column:
    squares = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def distance(a: _Col, b: _Col) -> Column:
    return F.sqrt(squared_distance(a, b))


def salience(local: _Col, everywhere: _Col, sentences: float = 1e8) -> Column:
    """(1 + log10(local)²) · log10(sentences / everywhere); -1 for a term without a global count."""
    s = (1 + F.pow(F.log10(col(local)), F.lit(2.0))) * F.log10(F.lit(sentences) / col(everywhere))
    return F.when(col(everywhere).isNull(), -1.0).otherwise(s)


def rank_overlap(a: _Col, b: _Col) -> Column:
    """Rank-biased overlap of weight 1: the mean, over depths up to the shorter list, of the share that both have."""
    a, b = col(a), col(b)
    k = F.least(F.size(a), F.size(b))
    at = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d
    return F.when(k == 0, 0.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), k), at), F.lit(0.0), lambda s, x: s + x) / k)


def event_time(text: _Col, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy")) -> Column:
    """The first of the formats that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(col(text), F.lit(f)) for f in formats])


def event_count(sentences: _Col) -> Column:
    """Events in an array of sentences, each a struct with an array events."""
    return F.aggregate(F.transform(col(sentences), lambda s: F.coalesce(F.size(s["events"]), F.lit(0))), F.lit(0), lambda a, n: a + n)


def top_tokens(expansion: _Col, k: int) -> Column:
    """The k most probable of an array of structs (tok, p), ties by token."""
    ordered = F.array_sort(F.transform(col(expansion), lambda x: F.struct((-x["p"]).alias("q"), x["tok"].alias("tok"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["tok"].alias("tok"), (-x["q"]).alias("p")))
