"""Page sets as model input: rungs, interleaving, prompts, token accounts, scan classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each prompt mode tells the model.
INSTRUCTIONS = {
    "none": "",
    "grounded": "Use only the provided document evidence and keep the answer concise.",
    "abstain": "Use only the provided document evidence. If the evidence does not contain the answer, answer exactly: Not answerable.\nKeep the answer concise.",
    "abstain_balanced": "Use only the provided document evidence. If the evidence does not contain the answer, answer exactly: Not answerable. "
    "If the evidence does contain the answer, give it: do not decline a question the evidence supports.\nKeep the answer concise.",
    "cot": "Use only the provided document evidence. Think step by step before answering.\nThen write your final answer on a new line beginning with 'Answer:'. Keep the answer concise.",
    "extract_cot": "Use only the provided document evidence.\nFirst copy out, verbatim, the passages from the document evidence that bear on the question, each on its own line. "
    "Where the relevant evidence is a chart, figure, table, or other visual element, describe what it shows in enough detail to answer from your description alone.\n"
    "Then reason step by step using only the evidence you set out above.\nThen write your final answer on a new line beginning with 'Answer:'. Keep the answer concise.",
}
INSTRUCTIONS |= {"generic": INSTRUCTIONS["grounded"], "targeted": INSTRUCTIONS["abstain"]}


def block(label: str, texts: Column) -> Column:
    """'[label]' over the non-blank chunks; empty where all are blank."""
    kept = F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit(f"[{label}]\n"), F.array_join(kept, "\n\n")))


def payload(rung: Column, texts: Column, markdown: Column, images: Column, pages: Column) -> Column:
    """array<struct<kind, value>>: T text, TL text and parser markdown, TLV with page images, TLVi page by page, V images only."""
    part = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    t, m = block("text", texts), block("layout", markdown)
    text = F.array(part("text", t))
    both = F.array(part("text", F.array_join(F.filter(F.array(t, m), lambda x: x != ""), "\n\n")))
    shots = F.transform(images, lambda i: part("image", i))
    mixed = F.flatten(F.transform(F.arrays_zip(pages.alias("p"), markdown.alias("m"), images.alias("i")), lambda z: F.array(
        part("text", F.concat(F.lit("[page "), (z["p"] + 1).cast("string"), F.lit("]\n"), F.coalesce(z["m"], F.lit("")))), part("image", z["i"]))))
    out = F.when(rung == "T", text).when(rung == "TL", both).when(rung == "TLV", F.concat(both, shots)).when(rung == "TLVi", mixed).otherwise(shots)
    return F.filter(out, lambda x: ~((x["kind"] == "text") & (F.trim(x["value"]) == "")))


def prompt_text(parts: Column) -> Column:
    """Parts as one text; each image is a marker, markers in the text are escaped."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "image", "<image>").otherwise(F.replace(p["value"], F.lit("<image>"), F.lit("< image>")))), "\n\n")


def prompt(mode: Column, question: Column, body: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    lead = F.coalesce(F.element_at(table, mode), F.lit(""))
    return F.concat_ws("\n\n", F.when(lead != "", lead), F.when(F.trim(body) != "", body), F.concat(F.lit("Question: "), question), F.lit("Answer:"))


def decode_budget(mode: Column, budgets: dict[str, int], maximum: int = 256, smoke: bool = False) -> Column:
    b = F.lit(budgets.get("default", maximum))
    for k, v in budgets.items():
        if k != "default":
            b = F.when(mode == k, v).otherwise(b)
    return F.least(b, F.lit(64)) if smoke else b


def token_account(family: Column, grid: Column, tiles: Column, text: Column, output: Column) -> dict[str, Column]:
    """visual and output tokens by model family; columns of different families do not compare."""
    from ..functions.scalar import grid_tokens, text_tokens

    visual = F.when(family == "grid", grid_tokens(grid)).when(family == "tile", tiles * 256).otherwise(F.least(tiles, F.lit(4)) * 1601)
    return {"visual_tokens": visual.cast("long"), "text_tokens": text_tokens(text), "output_tokens": text_tokens(output)}


def nearest_tiles(budget: Column, most: int = 12, tile: int = 448) -> Column:
    """The number of tiles whose pixels come nearest to a budget; ties: fewer."""
    options = F.array(*[F.struct(F.abs(F.lit(n * tile * tile) - budget).alias("d"), F.lit(n).alias("n")) for n in range(1, most + 1)])
    return F.array_min(options)["n"]


def scan_class(pages: DataFrame, first: int = 5, least: int = 20) -> DataFrame:
    """doc_id, pages, avg_chars, auto_scan of the first pages' text."""
    from .retrieval import page_text

    n = F.length(F.trim(F.regexp_replace(page_text(F.col("text_spans")), r"^\s+|\s+$", "")))
    p = pages.select("doc_id", "page_index", n.alias("n")).filter(F.col("page_index") < first)
    a = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("n"), 1).alias("avg_chars"), F.count_if(F.col("n") >= least).alias("texty"))
    return a.select("doc_id", "pages", "avg_chars", F.when((F.col("texty") == 0) | (F.col("avg_chars") < least), "scanned").otherwise("digital").alias("auto_scan"))


def tile_grid(aspect: Column, most: int = 12) -> Column:
    """struct(cols, rows): the tiling of at most so many tiles that comes nearest to width / height; ties: more tiles."""
    options = [F.struct(F.abs(aspect - F.lit(c / r)).alias("d"), F.lit(-c * r).alias("n"), F.lit(c).alias("cols"), F.lit(r).alias("rows")) for c in range(1, most + 1) for r in range(1, most // c + 1)]
    best = F.array_min(F.array(*options))
    return F.struct(best["cols"].alias("cols"), best["rows"].alias("rows"))


def tile_count(grid: Column, overview: bool = True) -> Column:
    """Tiles of a tiling; several ones get an overview of the whole page."""
    n = grid["cols"] * grid["rows"]
    return n + F.when(F.lit(overview) & (n > 1), 1).otherwise(0)


def chat_messages(parts: Column) -> Column:
    """The parts as the JSON of one user message; images in base64."""
    content = F.transform(parts, lambda p: F.struct(p["kind"].alias("type"), F.when(p["kind"] == "image", F.base64(p["value"].cast("binary"))).otherwise(p["value"]).alias("value")))
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))


def chat_parts(message: Column) -> Column:
    """The parts of a message's JSON, the reverse of chat_messages."""
    m = F.from_json(message, "array<struct<role:string,content:array<struct<type:string,value:string>>>>")
    return F.transform(m[0]["content"], lambda p: F.struct(p["type"].alias("kind"), F.when(p["type"] == "image", F.unbase64(p["value"]).cast("string")).otherwise(p["value"]).alias("value")))


def split_prompt(prompt_column: Column, images: Column) -> Column:
    """array<struct<kind, value>>: the pieces of a prompt between its image markers, each marker replaced by the next image; another number of images raises."""
    pieces = F.split(prompt_column, "<image>", -1)
    count = F.size(pieces) - 1 == F.size(images)
    mixed = F.flatten(F.transform(pieces, lambda t, i: F.array(
        F.struct(F.lit("text").alias("kind"), t.alias("value")), F.struct(F.lit("image").alias("kind"), F.get(images, i).alias("value")))))
    kept = F.filter(mixed, lambda x: x["value"].isNotNull() & ~((x["kind"] == "text") & (F.trim(x["value"]) == "")))
    return F.when(count, kept).otherwise(F.raise_error(F.lit("the prompt's image markers and the images differ in number")).cast("array<struct<kind:string,value:string>>"))
