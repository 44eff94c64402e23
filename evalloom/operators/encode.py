"""Prompt rendering, tokenising, truncation and label masking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import arrays, text
from evalloom.functions.core import or_empty, strip_ws
from evalloom.operators.counts import FEW_TEXTS
from evalloom.operators.ranges import lookup, sorted_rank
from evalloom.sources.scratch import settle

TOKEN_BREAK = r"\s+"


def attach_template(df: DataFrame, templates: DataFrame, default: str = text.DEFAULT_TEMPLATE) -> DataFrame:
    """Template of each row by ``type`` from a (type, template) table; others get the default.

    A table of up to ``FEW_TEXTS`` templates goes to all tasks; rows are then not shuffled by their type, which a few types share.
    """
    named = templates.select("type", "template")
    few = named.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
    return df.join(F.broadcast(named) if few else named, "type", "left").withColumn("template", F.coalesce("template", F.lit(default)))


def split_words(value: Column, most: int | None = None) -> Column:
    """White-space separated tokens, the first ``most`` if given; what stands after these is not split then."""
    if most is None:
        return F.array_remove(F.split(or_empty(value), TOKEN_BREAK), "")
    # One piece more for what may stand before the first break, one for the rest.
    return F.slice(F.array_remove(F.slice(F.split(or_empty(value), TOKEN_BREAK, most + 2), 1, most + 1), ""), 1, most)


def build_vocab(df: DataFrame, column: str, first_id: int = 0, words: Callable[[Column], Column] = split_words) -> DataFrame:
    """Vocabulary (token, id, n): ids follow byte order of the tokens, ``n`` counts occurrences."""
    counts = df.select(F.explode(words(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # The range shuffle samples its input first, so the text is read once for the written counts; the result is written too.
    ranked = sorted_rank(settle(counts), [F.col("token")], "id")
    return settle(ranked.select("token", (F.col("id") - 1 + first_id).cast("int").alias("id"), "n"))


@dataclass
class VocabTokenizer:
    """Tokenizer whose vocabulary (token, id, n) is a stored table. Encoding is a join, so it may be of any size."""

    vocab: DataFrame
    unk_id: int = 0
    eos_id: int | None = None
    bos_id: int | None = None
    pad_id: int | None = None
    words: Callable[[Column], Column] = split_words

    def encode(
        self, df: DataFrame, columns: Mapping[str, str], keep: Sequence[str], most: int | None = None, lengths: bool = False
    ) -> DataFrame:
        """Rows of ``keep`` (a unique key and what travels with it) plus id lists, given as {output: text column}.

        A list that is cut to ``most`` tokens later on is cut before its tokens are looked up.
        ``lengths`` adds the full length of every list as ``{output}_n``.
        """
        if lengths:
            df = df.withColumns({f"{out}_n": F.size(self.words(F.col(source))) for out, source in columns.items()})
            keep = [*keep, *[f"{out}_n" for out in columns]]

        def first(value: Column) -> Column:
            if self.words is split_words:
                return split_words(value, most)
            return self.words(value) if most is None else F.slice(self.words(value), 1, most)

        sides = F.array(
            *[
                F.struct(F.lit(out).alias("side"), first(F.col(source)).alias("words"))
                for out, source in columns.items()
            ]
        )
        long = (
            df.select(*keep, F.explode(sides).alias("_s"))
            .select(*keep, F.col("_s.side").alias("_side"), F.posexplode_outer("_s.words").alias("_pos", "token"))
        )
        found = lookup(long, self.vocab.select("token", "id", "n"), ["token"], "n", stored=True)
        at = F.struct("_side", "_pos", F.coalesce("id", F.lit(self.unk_id)).alias("id"))
        # One row's tokens come back together: the group is as large as the text it came from.
        grouped = found.groupBy(*keep).agg(F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), at))).alias("_t"))

        def side(name: str) -> Column:
            return F.transform(F.filter("_t", lambda t: t["_side"] == name), lambda t: t["id"]).alias(name)

        return grouped.select(*keep, *[side(out) for out in columns])


@dataclass
class ArrowTokenizer:
    """A user's own tokenizer: ``load()`` runs once per Python worker and returns ``list[str] -> list[list[int]]``."""

    load: Callable[[], Callable[[list[str]], list[list[int]]]]
    eos_id: int | None = None
    bos_id: int | None = None
    pad_id: int | None = None

    def encode(
        self, df: DataFrame, columns: Mapping[str, str], keep: Sequence[str], most: int | None = None, lengths: bool = False
    ) -> DataFrame:
        load = self.load
        cut = lambda ids: ids if most is None else F.slice(ids, 1, most)

        @F.pandas_udf("array<int>")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for batch in batches:
                yield pd.Series(encode(batch.fillna("").tolist()), index=batch.index, dtype=object)

        found = df.select(*keep, *[ids(F.col(source)).alias(out) for out, source in columns.items()])
        sizes = [F.size(out).alias(f"{out}_n") for out in columns] if lengths else []
        return found.select(*keep, *sizes, *[cut(F.col(out)).alias(out) for out in columns])


@dataclass(frozen=True)
class PairTemplate:
    """Layout of one text and of two texts among special ids.

    A layout is a list of (piece, segment): the piece is ``"A"`` or ``"B"`` for a text's ids, or a special id. Each
    text stands in it once.
    """

    single: Sequence[tuple[str | int, int]]
    pair: Sequence[tuple[str | int, int]]

    def __post_init__(self) -> None:
        for layout, texts in ((self.single, ["A"]), (self.pair, ["A", "B"])):
            if sorted(p for p, _ in layout if isinstance(p, str)) != texts:
                raise ValueError(f"a layout must hold each of {texts} once: {list(layout)}")

    @classmethod
    def two_segments(cls, start: int, separator: int) -> PairTemplate:
        """Start, first text, separator; then second text and separator as segment 1."""
        first = [(start, 0), ("A", 0), (separator, 0)]
        return cls(first, [*first, ("B", 1), (separator, 1)])

    @classmethod
    def one_segment(cls, start: int, end: int) -> PairTemplate:
        """Start, first text, end; then end, second text and end, all of one segment."""
        first = [(start, 0), ("A", 0), (end, 0)]
        return cls(first, [*first, (end, 0), ("B", 0), (end, 0)])

    def layout(self, texts: int) -> Sequence[tuple[str | int, int]]:
        return self.pair if texts == 2 else self.single

    def reserved(self, texts: int) -> int:
        """Places that special ids take."""
        return sum(not isinstance(p, str) for p, _ in self.layout(texts))

    def lay_out(self, lists: Mapping[str, Column]) -> dict[str, Column]:
        """``input_ids``, ``token_type_ids`` and ``special_tokens_mask`` from the texts' fitted ids."""
        pieces = [(lists[p] if isinstance(p, str) else F.array(F.lit(p)), segment, not isinstance(p, str)) for p, segment in self.layout(len(lists))]
        return {
            "input_ids": F.concat(*[ids for ids, _, _ in pieces]),
            "token_type_ids": F.concat(*[F.array_repeat(F.lit(segment), F.size(ids)) for ids, segment, _ in pieces]),
            "special_tokens_mask": F.concat(*[F.array_repeat(F.lit(int(special)), F.size(ids)) for ids, _, special in pieces]),
        }


def render_examples(df: DataFrame, target: str = "response", strip: bool = True) -> DataFrame:
    """Add ``prompt`` and ``target`` text to typed examples (type, query, …)."""
    wanted = or_empty(F.col(target))
    return df.withColumn("prompt", text.render_prompt(text.template_for(F.col("type")), F.col("query"), strip)).withColumn(
        "target", strip_ws(wanted) if strip else wanted
    )


def drop_empty_targets(df: DataFrame, target: str = "target_ids") -> DataFrame:
    return df.filter(F.size(target) > 0)


def assemble_pair(
    df: DataFrame,
    max_length: int | None,
    eos_id: int | None = None,
    bos_id: int | None = None,
    truncate_prompt_only: bool = True,
    truncate_from_end: bool = True,
) -> DataFrame:
    """``prompt_ids`` and ``target_ids`` to ``input_ids``, ``labels`` and ``attention_mask``; other columns stay."""
    others = [c for c in df.columns if c not in ("prompt_ids", "target_ids")]
    special = df.select(
        *others,
        arrays.append_special(F.col("prompt_ids"), bos=bos_id).alias("prompt_ids"),
        arrays.append_special(F.col("target_ids"), eos=eos_id).alias("target_ids"),
    )
    pair = arrays.fit_pair(
        F.col("prompt_ids"), F.col("target_ids"), max_length, truncate_prompt_only, truncate_from_end
    )
    fitted = special.select(*others, pair.alias("_pair")).select(
        *others, F.col("_pair.prompt").alias("prompt_ids"), F.col("_pair.target").alias("target_ids")
    )
    return drop_empty_targets(fitted).select(
        *others,
        F.concat("prompt_ids", "target_ids").alias("input_ids"),
        arrays.mask_labels(F.col("prompt_ids"), F.col("target_ids")).alias("labels"),
        arrays.ones_like(F.concat("prompt_ids", "target_ids")).alias("attention_mask"),
    )


def encode_sft(
    df: DataFrame,
    tokenizer,
    max_length: int | None = 1024,
    append_eos: bool = True,
    add_bos: bool = False,
    truncate_prompt_only: bool = True,
    truncate_from_end: bool = True,
    strip_prompt: bool = True,
    target_field: str = "response",
    keep: Sequence[str] = ("idx", "split"),
) -> DataFrame:
    """Typed examples to encoded rows; rows whose target is cut away are dropped."""
    rendered = render_examples(df, target_field, strip_prompt).select(*keep, "prompt", "target")
    ids = tokenizer.encode(rendered, {"prompt_ids": "prompt", "target_ids": "target"}, keep)
    return assemble_pair(
        ids,
        max_length,
        tokenizer.eos_id if append_eos else None,
        tokenizer.bos_id if add_bos else None,
        truncate_prompt_only,
        truncate_from_end,
    )


def rename_label(df: DataFrame, label_column: str = "label") -> DataFrame:
    """The label column becomes ``labels``; an existing ``labels`` stays where there is no such column."""
    if label_column in df.columns and label_column != "labels":
        return df.drop("labels").withColumnRenamed(label_column, "labels")
    return df


def encode_pair(
    df: DataFrame,
    tokenizer,
    text_column: str | Sequence[str],
    max_length: int = 512,
    label_column: str = "label",
    keep: Sequence[str] = ("idx", "split"),
    template: PairTemplate | None = None,
) -> DataFrame:
    """One text or a text pair to ids of exactly ``max_length``, padded, with mask and label.

    A pair is cut from its longer side until it fits. A ``template`` reserves the places of its special ids first, cuts
    a pair to halves (see :func:`arrays.fit_halves`), and adds ``token_type_ids`` (padding is segment 0) and
    ``special_tokens_mask`` (padding counts as special).
    """
    columns = [text_column] if isinstance(text_column, str) else list(text_column)
    if len(columns) != 2:
        columns = columns[:1]
    budget = max_length - (template.reserved(len(columns)) if template else 0)
    if budget < 0:
        raise ValueError(f"{max_length} places cannot hold the template's {template.reserved(len(columns))} special ids")
    pad = tokenizer.pad_id if tokenizer.pad_id is not None else (tokenizer.eos_id or 0)
    named = rename_label(df, label_column)
    carried = [*keep, *(["labels"] if "labels" in named.columns else [])]
    ids = tokenizer.encode(named, {f"ids{i}": c for i, c in enumerate(columns)}, carried, most=budget, lengths=template is not None)
    first, second = F.col("ids0"), F.col("ids1")
    if len(columns) == 2:
        fit = arrays.fit_halves(first, second, F.col("ids0_n"), F.col("ids1_n"), budget) if template else arrays.fit_longest_first(first, second, budget)
        fitted, lists = ids.withColumn("_fit", fit), {"A": F.col("_fit.first"), "B": F.col("_fit.second")}
    else:
        fitted, lists = ids, {"A": F.slice(first, F.lit(1), F.lit(budget))}
    made = template.lay_out(lists) if template else {"input_ids": F.concat(*lists.values())}
    fillers = {"input_ids": pad, "token_type_ids": 0, "special_tokens_mask": 1}
    return fitted.select(*carried, *[column.alias(name) for name, column in made.items()]).select(
        *carried,
        arrays.pad_to(F.col("input_ids"), max_length, pad).alias("input_ids"),
        arrays.pad_to(arrays.ones_like(F.col("input_ids")), max_length, 0).alias("attention_mask"),
        *[arrays.pad_to(F.col(name), max_length, fillers[name]).alias(name) for name in made if name != "input_ids"],
    )


# The dataset names that have a processor.
PROCESSORS: dict[str, Callable[..., DataFrame]] = {text.MATH_DATASET: encode_sft, "glue": encode_pair}


def processor_for(dataset_name: str) -> Callable[..., DataFrame]:
    if dataset_name not in PROCESSORS:
        raise ValueError(f"no processor for dataset {dataset_name!r}; known: {', '.join(sorted(PROCESSORS))}")
    return PROCESSORS[dataset_name]
