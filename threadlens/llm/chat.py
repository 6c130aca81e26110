"""Chat formatting of messages made of typed parts.

A message is a list of parts: text, image, audio or document. Parts are visited in
order; text is escaped, any other part becomes an ordered placeholder with an attachment
reference and the number of tokens it expands to, followed by its own text, if it has one.
Control strings are `<|turn ROLE|>`, `<|end|>` and `<|part KIND TURN.PART|>`, which stands before
every part but a leading text. Inside roles, kinds and texts a backslash becomes `\\b` and a
bar `\\p`, so no control string can occur there and the parts can be read back one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import pick

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LOSS_ROLE = "assistant"

#: Tokens an attachment expands to: per image tile of 512 pixels a side and once per
#: image, per second of audio, per document page.
TILE, TILE_TOKENS, IMAGE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 600


def escaped(text: str) -> str:
    return rf"replace(replace({text}, '\\', '\\b'), '|', '\\p')"


def unescaped(text: str) -> str:
    return rf"replace(replace({text}, '\\p', '|'), '\\b', '\\')"


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")
    )]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *empty)).cast(f"array<{PART}>")


def expansion(part: str) -> str:
    """Tokens that an attachment stands for; missing sizes count as the least."""
    tiles = (
        f"greatest(1L, bigint(ceil(coalesce({part}.width, 1) / {TILE}))) * "
        f"greatest(1L, bigint(ceil(coalesce({part}.height, 1) / {TILE})))"
    )
    return (
        f"CASE {part}.kind WHEN 'image' THEN {IMAGE_TOKENS} + {TILE_TOKENS} * {tiles} "
        f"WHEN 'audio' THEN bigint(ceil(greatest(coalesce({part}.seconds, 0D), 0D) * {SECOND_TOKENS})) "
        f"WHEN 'document' THEN {PAGE_TOKENS}L * greatest(coalesce({part}.pages, 1), 1) ELSE 0L END"
    )


def kind_of(part: str) -> str:
    """A part without a kind, or a missing part, is text."""
    return f"coalesce({part}.kind, 'text')"


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts).

    formatted      the whole conversation as one string
    segments       array of (text, loss): the string in pieces; loss marks what is learned
    attachments    array of (turn, part, kind, ref, tokens) in order of appearance
    expanded_tokens  what all attachments expand to

    Turns are ordered by turn, nulls last, then role, then parts; equal rows all stay. A
    null role is empty, null parts are none, a null text is empty, a null kind is text: the text of
    any part is kept. Placeholders are never learned, texts of the assistant are. Rows with a null
    conv_id make one conversation. A conversation is one string, so its size is bounded by
    the conversation, as its order demands.
    """
    rows = pick(messages, "conv_id", "turn", "role", "parts")
    ordered = F.struct(
        F.col("turn").isNull().alias("late"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(ordered)).alias("turns"))
    marker = (
        f"if(j = 0 AND {kind_of('p')} = 'text', '', "
        f"concat('<|part ', {escaped(kind_of('p'))}, ' ', k, '.', j, '|>'))"
    )
    content = (
        "flatten(transform(t.parts, (p, j) -> array("
        f"named_struct('text', {marker}, 'loss', false), "
        f"named_struct('text', {escaped('coalesce(p.text, \'\')')}, 'loss', t.role = '{LOSS_ROLE}'))))"
    )
    segments = (
        "flatten(transform(turns, (t, k) -> concat(array("
        f"named_struct('text', concat('<|turn ', {escaped('t.role')}, '|>\\n'), 'loss', false)), "
        f"{content}, array(named_struct('text', '<|end|>\\n', 'loss', false)))))"
    )
    references = (
        f"filter(flatten(transform(turns, (t, k) -> transform(t.parts, (p, j) -> if({kind_of('p')} = 'text', NULL, "
        f"named_struct('turn', k, 'part', j, 'kind', p.kind, 'ref', p.ref, 'tokens', {expansion('p')}))))), "
        "a -> a IS NOT NULL)"
    )
    built = chats.select(
        "conv_id", F.expr(f"filter({segments}, s -> s.text <> '')").alias("segments"), F.expr(references).alias("attachments")
    )
    return built.select(
        "conv_id",
        F.expr("array_join(transform(segments, s -> s.text), '')").alias("formatted"),
        "segments",
        "attachments",
        F.expr("aggregate(attachments, 0L, (n, a) -> n + a.tokens)").alias("expanded_tokens"),
    )


def read_turns(formatted: str = "formatted") -> Column:
    """array<struct<role, text, parts>> read back from a formatted conversation.

    `parts` has (kind, text, part) of every part, the last its place, by which `attachments` adds
    reference and tokens; `text` is all texts of the turn. A message without parts reads as one empty text.
    """
    body = "substring_index(substr(piece, instr(piece, '|>') + 3), '<|end|>', 1)"
    role = unescaped("substring_index(piece, '|>', 1)")
    # What follows a marker's beginning: KIND TURN.PART|>TEXT.
    marker, number = "substring_index(x, '|>', 1)", "substring_index(substring_index(x, '|>', 1), ' ', -1)"
    kind = f"substr({marker}, 1, length({marker}) - length({number}) - 1)"
    marked = (
        f"transform(slice(cut, 2, size(cut)), x -> named_struct('kind', {unescaped(kind)}, "
        f"'text', {unescaped('substr(x, instr(x, \'|>\') + 2)')}, 'part', int(substring_index({number}, '.', -1))))"
    )
    leading = f"named_struct('kind', 'text', 'text', {unescaped('cut[0]')}, 'part', 0)"
    parts = f"if(size(cut) > 1 AND substring_index({marker.replace('(x', '(cut[1]')}, '.', -1) = '0', {marked}, concat(array({leading}), {marked}))"
    whole = "array_join(transform(parts, p -> p.text), '')"
    cuts = f"transform(array({body}), y -> split(y, '<\\\\|part ', -1))"
    read = f"transform({cuts}, cut -> {parts})[0]"
    told = f"transform(array({read}), parts -> named_struct('role', {role}, 'text', {whole}, 'parts', parts))[0]"
    return F.expr(f"transform(filter(split({formatted}, '<\\\\|turn ', -1), (piece, k) -> k > 0), piece -> {told})")


def read_loss(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.expr(f"array_join(transform(filter({segments}, s -> s.loss), s -> {unescaped('s.text')}), '')")
