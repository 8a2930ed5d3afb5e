"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from threatlake.functions.fixed import SPACES

# Two control characters that no pattern mentions.  Input occurrences of MARK become SPARE
# before MARK is used, which changes neither offsets nor any match.
MARK = chr(1)
SPARE = chr(2)

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without this the optimizer may copy an expensive expression into a lambda and run it again
    for every element.
    """
    return F.transform(F.array(value), body)[0]


def empty_array(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def blank_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def drop_nulls(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; repeated keys are allowed, trailing text is not.

    The text is read as the first of two items of a list.  The second is a digest of the text, so
    no text can close the list and put another second item there.  Null is no JSON.
    """
    mark = F.md5(text)
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')),
        "array<string>",
        {"allowSingleQuotes": "false"},
    )
    return F.coalesce((F.size(items) == 2) & (F.get(items, F.lit(1)) == mark), F.lit(False))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def word_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small literal map, null when absent."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def first_true(rules: list[tuple[Column, str]], otherwise: str | Column) -> Column:
    """Label of the first rule that holds."""
    chain = None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain.otherwise(otherwise)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def marked_pieces(text: Column, pattern: str) -> Column:
    """The text cut at every match: gap, match, gap, ..., gap.

    One regex pass marks the matches and a plain split cuts at the marks.
    """
    marked = F.regexp_replace(
        F.replace(text, F.lit(MARK), F.lit(SPARE)), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")
    )
    return F.split(marked, MARK, -1)


def match_spans(pieces: Column) -> Column:
    """Matches of :func:`marked_pieces` as array<struct<value, start>>, 0-based code points.

    A match starts after all pieces before it.  Lengths are summed per block of pieces, so that a
    text with very many matches stays near linear.
    """

    def block(b: Column, at: Column, all_pieces: Column) -> Column:
        return let(
            F.slice(all_pieces, b * _BLOCK + 1, _BLOCK),
            lambda own: drop_nulls(
                F.transform(
                    own,
                    lambda piece, i: F.when(
                        i % 2 == 1,
                        F.struct(
                            piece.alias("value"),
                            (at + _length(F.slice(own, F.lit(1), i))).alias("start"),
                        ),
                    ),
                )
            ),
        )

    def long_spans(p: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")),
            lambda b: _length(F.slice(p, b * _BLOCK + 1, _BLOCK)),
        )
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(
                    s,
                    lambda _, b: block(
                        b, F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda t, n: t + n), p
                    ),
                )
            ),
        )

    def spans(p: Column) -> Column:
        short = block(F.lit(0), F.lit(0), p)
        return F.when(F.size(p) <= _BLOCK, short).otherwise(long_spans(p))

    return let(pieces, spans)


TEXT_BLOCK = 512


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``TEXT_BLOCK`` code points, an index for :func:`text_span`."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return F.when(F.length(text) <= TEXT_BLOCK, F.array(text)).otherwise(cut)


def text_span(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of the text that :func:`text_blocks` cut.

    A substring of the whole text would be searched for from the beginning every time; here the cost
    is that of the span and of the blocks it touches.
    """
    first = F.floor(start / TEXT_BLOCK).cast("int")
    touched = F.floor((end - 1) / TEXT_BLOCK).cast("int") - first + 1
    near = F.when(F.size(blocks) == 1, blocks[0]).otherwise(
        F.array_join(F.slice(blocks, first + 1, F.greatest(touched, F.lit(1))), "")
    )
    return F.substring(near, start - first * TEXT_BLOCK + 1, end - start)


def _length(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda total, piece: total + F.length(piece))
