"""Answers as XML, priced in tokens. The map is put together file by file on the executors; other answers are read row by
row, in order, and the text itself is what the driver holds."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml, extension, price
from ..sources.index import Index
from .verbs import Answer

FLAT_RATE, COMPOSED_RATE = 3.80, 2.50
# Fixed values of the map's price model: bytes of markup, and bytes a token of content by extension.
ENVELOPE, FILE_MARKUP, SYMBOL_MARKUP, EDGE_MARKUP = 320, 12, 30, 9
CONTENT_RATES = {"go": 2.53, "java": 2.55}
ROUNDS = 4

LEGENDS = {
    "map": ("<!-- symbols by rank, the most linked first; n name, k rank, l line; c lists callees -->", "<!-- by rank -->"),
    "grep": ("<!-- hit: l line, in enclosing definition, callers how many call that -->", "<!-- hits -->"),
    "callers": ("<!-- one hop; t kind, n name, p file:line; tests and docs last -->", "<!-- callers -->"),
    "callees": ("<!-- one hop; t kind, n name, p file:line; tests and docs last -->", "<!-- callees -->"),
    "uses": ("<!-- places that refer to the name, each in its enclosing definition -->", "<!-- uses -->"),
    "at": ("<!-- definitions around the line, innermost first -->", "<!-- at -->"),
    "impact": ("<!-- everything that reaches the symbol over calls, by level -->", "<!-- impact -->"),
    "expand": ("<!-- body with siblings, imports and signatures of callees, or the whole file where that is smaller -->", "<!-- body -->"),
    "for": ("<!-- symbols by how well they fit the task; r place, in callers, amp transitive callers -->", "<!-- task -->"),
    "from-trace": ("<!-- frames in order; the first one found comes with its body -->", "<!-- trace -->"),
}


def pick_legend(verb: str, payload: str) -> str:
    """The compact legend where the payload is shorter than the full one."""
    full, compact = LEGENDS[verb]
    return compact if len(payload.encode()) < len(full.encode()) else full


def flat_price(n_bytes: int, rate: float = FLAT_RATE) -> int:
    return int(n_bytes / rate + 0.5)


def settle(build: Callable[[int], str], rate: float, start: int = 0) -> tuple[int, str]:
    """The price that a document states about itself, found in at most ROUNDS rounds."""
    est, doc = start, build(start)
    for _ in range(ROUNDS):
        nxt = flat_price(len(doc.encode()), rate)
        if nxt == est:
            break
        est, doc = nxt, build(nxt)
    return est, doc


def _value(v) -> str:
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.4f}"
    if isinstance(v, (list, tuple)):
        return ",".join(map(str, v))
    return str(v)


def attributes(values: dict, apostrophes: bool = False) -> str:
    """name="value" for everything that is not null."""
    esc = lambda s: escape(s, quote=False).replace('"', "&quot;").replace("'", "&apos;" if apostrophes else "'")
    return "".join(f' {k}="{esc(_value(v))}"' for k, v in values.items() if v is not None)


def cdata(text: str) -> str:
    return "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def _escaped(c: Column) -> Column:
    return F.octet_length(escape_xml(c, quotes=True))


def bundle_bytes() -> Column:
    """Bytes of a body with its context as an answer would hold it, from a row of verbs.bundle()."""
    joined = lambda c: _escaped(F.array_join(c, ","))
    legend = len(LEGENDS["expand"][0].encode())
    frame = len('<bodies shown="1" total="1" capped="0"><b n="" t="" l="" p="" sibs="" sibs_total="" inc="" inc_total=""><![CDATA[]]></b></bodies>')
    calls = F.aggregate("callee_sigs", F.lit(0), lambda s, c: s + _escaped(c) + len("<c></c>"))
    return (F.lit(legend + frame) + _escaped(F.col("name")) + F.octet_length("kind") + F.length(F.col("line").cast("string")) + _escaped(F.col("path"))
            + joined("sibs") + joined("inc") + F.octet_length(F.coalesce("body", F.lit(""))) + calls)


def expand_price(root: str) -> Column:
    """Tokens of the document that holds the row's text, its own price's digits included: ROUNDS rounds from 0."""
    head = len(f'<ctx root="{escape(root)}" mode="" reason=""><src p="" sym=":"><![CDATA[]]></src></ctx>'.encode())
    fixed = F.lit(head) + F.octet_length("mode") + _escaped(F.col("reason")) + _escaped(F.col("path")) + _escaped(F.col("name")) + F.length(
        F.col("line").cast("string")) + F.octet_length("text")
    est = F.lit(0).cast("bigint")
    for _ in range(ROUNDS):
        est = price(fixed + len(' est_tokens=""') + F.length(est.cast("string")))
    return est


def map_model(index: Index, root: str) -> DataFrame:
    """One row: tokens and bytes of the map's price model. Content is summed by extension in one aggregation."""
    top = len(root.rstrip("/").encode()) + 1
    s = index.symbols.join(index.files.select("file_id", "path"), "file_id")
    ext = F.when(extension(F.col("path")) != "", extension(F.col("path"))).otherwise(F.col("path")).alias("ext")
    calls = index.edges.select(F.col("src").alias("sym_id"), "dst").join(index.symbols.select(F.col("sym_id").alias("dst"), F.octet_length("name").alias("n")), "dst")
    calls = calls.groupBy("sym_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("callee_bytes"))
    own = s.join(calls, "sym_id", "left").groupBy("file_id", ext).agg(
        (F.first(F.octet_length("path")) + top).alias("path_bytes"), F.count(F.lit(1)).alias("symbols"), F.sum(F.octet_length("name")).alias("name_bytes"),
        F.sum(F.coalesce("edges", F.lit(0))).alias("edges"), F.sum(F.coalesce("callee_bytes", F.lit(0))).alias("callee_bytes"))
    by = own.groupBy("ext").agg(
        F.sum(F.col("path_bytes") + F.col("name_bytes") + F.col("callee_bytes")).alias("content"),
        F.sum(FILE_MARKUP + SYMBOL_MARKUP * F.col("symbols") + EDGE_MARKUP * F.col("edges")).alias("markup"))
    rate = F.lit(COMPOSED_RATE)
    for e, r in CONTENT_RATES.items():
        rate = F.when(F.col("ext") == e, F.lit(r)).otherwise(rate)
    total = by.agg(
        F.coalesce(F.sum(F.col("content") / rate + F.col("markup") / F.lit(COMPOSED_RATE)), F.lit(0.0)).alias("t"),
        F.coalesce(F.sum(F.col("content") + F.col("markup")), F.lit(0)).alias("b"))
    return total.select(F.floor(F.col("t") + F.lit(ENVELOPE / COMPOSED_RATE) + F.lit(0.5)).alias("tokens"), (F.col("b") + ENVELOPE).alias("bytes"))


def render_map(index: Index, answer: Answer, root: str, cache: str = "rebuilt") -> str:
    """The ranked map: files in the order of their best symbol, symbols by rank in each, callees inside."""
    esc = escape_xml
    callees = F.array_join(F.transform("callees", lambda c: F.concat(F.lit('<c n="'), esc(c), F.lit('"/>'))), "")
    open_tag = F.concat(F.lit("<"), "t", F.lit(' n="'), esc(F.col("n")), F.lit('" k="'), F.format_string("%.4f", "k"), F.lit('"'))
    element = F.concat(open_tag, F.when(F.size("callees") > 0, F.concat(F.lit(">"), callees, F.lit("</"), "t", F.lit(">"))).otherwise(F.lit("/>")))
    # A file's element is put together where its rows are; the driver only joins them, file by file.
    placed = answer[0].select("path", "layer", F.struct((-F.col("rank")).alias("down"), "sym_id", element.alias("xml")).alias("s"))
    per_file = placed.groupBy("path", "layer").agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        F.col("s")[0]["down"].alias("down"), F.col("s")[0]["sym_id"].alias("sym_id"), F.size("s").alias("shown"),
        F.concat(F.lit('<f p="'), esc(F.col("path")), F.lit('"'), F.when(F.col("layer") != "", F.concat(F.lit(' layer="'), esc(F.col("layer")), F.lit('"'))).otherwise(F.lit("")),
                 F.lit(">"), F.array_join(F.transform("s", lambda x: x["xml"]), ""), F.lit("</f>")).alias("xml"))
    summary, shown, parts = answer[1].first(), 0, []
    for r in per_file.orderBy("down", "sym_id").select("shown", "xml").toLocalIterator():
        shown += r["shown"]
        parts.append(r["xml"])
    body = "".join(parts)
    model = map_model(index, root).first()
    rate = model["bytes"] / model["tokens"] if model["tokens"] else COMPOSED_RATE
    legend = pick_legend("map", body)

    def build(est: int) -> str:
        head = {"root": root, "files": summary["files"], "symbols": summary["symbols"], "edges": summary["edges"], "shown": shown, "est_tokens": est,
                "pr_iters": summary["pr_iters"], "converged": summary["converged"], "cache": cache}
        return f"{legend}<r{attributes(head)}>{body}</r>"

    return settle(build, rate, model["tokens"])[1]


def render(verb: str, index: Index, answer: Answer, root: str = ".") -> str:
    """Any verb's answer. Flat answers are priced once before the price is put in; task and trace answers state a
    price that covers itself."""
    if verb == "map":
        return render_map(index, answer, root)
    rows, summary = answer[0].toLocalIterator(), answer[1].first()
    said = summary.asDict() if summary is not None else {}
    parts = []
    for r in rows:
        d = r.asDict()
        text = d.pop("text", None) if verb in ("grep", "expand") else d.pop("body", None)
        if verb == "expand":
            d.pop("body", None)
        parts.append(f"<row{attributes(d, apostrophes=True)}" + (f">{cdata(text)}</row>" if text is not None else "/>"))
    # What a summary lists comes after the rows.
    parts += [f"<enc{attributes(e.asDict(), apostrophes=True)}/>" for e in said.pop("enc", None) or ()]
    if "tail" in said:
        files, total = said.pop("tail") or [], said.pop("tail_total")
        inner = "".join(f"<f{attributes({'p': p}, apostrophes=True)}/>" for p in files)
        parts.append(f"<tail{attributes({'total': total, 'shown': len(files), 'capped': total > len(files)})}>{inner}</tail>")
    payload = "".join(parts)
    legend = pick_legend(verb, payload)

    def build(est: int) -> str:
        return f"{legend}<{verb}{attributes({'root': root, **said, 'est_tokens': est}, apostrophes=True)}>{payload}</{verb}>"

    if verb in ("for", "from-trace", "expand"):
        return settle(build, FLAT_RATE if verb == "expand" else COMPOSED_RATE)[1]
    bare = f"{legend}<{verb}{attributes({'root': root, **said}, apostrophes=True)}>{payload}</{verb}>"
    return build(flat_price(len(bare.encode())))
