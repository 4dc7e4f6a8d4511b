"""Page HTML as a table of elements.

`html_elements` turns pages into rows, one per element that can carry structured data,
and everything else in the library is joins and aggregates over those rows. The leaf is
a tokenizer with an open-element stack: void elements, implied end tags, raw-text
elements and entity decoding follow HTML; the full tree-construction algorithm (foster
parenting, reopening of formatting elements) is not reproduced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Element classes of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_TEXT = frozenset(("textarea", "title"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu "
    "nav ol p plaintext pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_LIMIT = frozenset(
    "applet button caption html marquee object table td template th".split()
)
FORMATTING = frozenset(
    "a b big code em font i nobr s small strike strong tt u".split()
)
SPECIAL = CLOSES_P | SCOPE_LIMIT | frozenset(
    "body col colgroup dd dt frameset head input li param script select style tbody "
    "textarea tfoot thead title tr".split()
)

# A page without any of these cannot hold structured data, so it is never parsed.
# JSON may spell a key with escapes, hence the last alternative.
MARKED_PAGE = r"(?i)itemscope|typeof|dangerouslysetinnerhtml|@context|\\u00[0-9a-f]{2}"

ELEMENT_FIELDS = [
    T.StructField("elem_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("end_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("scope_id", T.IntegerType()),
    T.StructField("vocab", T.StringType()),
    T.StructField("typed_ids", T.ArrayType(T.IntegerType())),
    T.StructField("id_first", T.BooleanType()),
]

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
_ATTRIBUTE = re.compile(
    r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?)"""
)
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")
_RAW_END = {
    tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW_TEXT | ESCAPABLE_TEXT
}


def _attribute_text(value: str) -> str:
    """Decode references in an attribute: a name without `;` is left alone before `=`
    or when it is only the beginning of a longer word."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        name, equals = m.group(1), m.group(2)
        if name[0] == "#":
            return html.unescape("&" + name) + equals
        if name in html5 and (name.endswith(";") or not equals):
            return html5[name] + equals
        return m.group()

    return _REFERENCE.sub(one, value)


class _Open:
    """An open element."""

    __slots__ = ("number", "row", "tag", "text_from", "wants_text", "scope", "vocab", "typed")

    def __init__(self, number, row, tag, text_from, wants_text, scope, vocab, typed):
        self.number, self.row, self.tag = number, row, tag
        self.text_from, self.wants_text = text_from, wants_text
        # `typed` is a chain: the element's own `typeof`, or the nearest above, then the next.
        self.scope, self.vocab, self.typed = scope, vocab, typed


def elements_of(source: str, keep: str) -> list[dict]:
    """Rows of one page in document order; `keep` is `marked`, `scripts`, `links`
    or `all`."""
    return sorted(closed_elements(source, keep), key=lambda row: row["elem_id"])


def closed_elements(source: str, keep: str) -> Iterator[dict]:
    """The rows of `elements_of` as soon as they are complete, which is when an element ends.

    Apart from the texts it gives out, time and memory are in proportion to the page: a text
    that was put together stays in one part, and open elements are found by tag."""
    complete: list[dict] = []
    chunks: list[str] = []
    stack: list[_Open] = []
    open_at: dict[str, list[int]] = {}
    seen_ids: set[str] = set()
    count = 0
    foreign = 0
    links_only = keep == "links"

    def finish(entry: _Open, innermost: bool):
        open_at[entry.tag].remove(entry.number) if not innermost else open_at[entry.tag].pop()
        if not open_at[entry.tag]:
            del open_at[entry.tag]
        if entry.row is not None:
            entry.row["end_id"] = count
            if entry.wants_text:
                entry.row["text"] = "".join(chunks[entry.text_from :])
                if innermost:
                    # All that are still open began before it: to them, this is one part.
                    chunks[entry.text_from :] = [entry.row["text"]]
            complete.append(entry.row)

    def pop():
        nonlocal foreign
        entry = stack.pop()
        if entry.tag in ("svg", "math"):
            foreign -= 1
        finish(entry, True)

    def close_through(index: int):
        while len(stack) > index:
            pop()

    def last_open(tags) -> int:
        """The number of the innermost open element with one of these tags, -1 if none is open."""
        if len(tags) < len(open_at):
            return max((open_at[t][-1] for t in tags if t in open_at), default=-1)
        return max((numbers[-1] for t, numbers in open_at.items() if t in tags), default=-1)

    def find_open(tags, limits) -> int:
        found = last_open(tags)
        if found < 0 or found < last_open(limits):
            return -1
        return bisect_left(stack, found, key=lambda entry: entry.number)

    def close_if_open(tags, limits):
        i = find_open(tags, limits)
        if i >= 0:
            close_through(i)

    def make_room(tag: str):
        """Apply the end tags a start tag implies."""
        if tag in CLOSES_P:
            close_if_open(("p",), SCOPE_LIMIT)
        if tag == "li":
            close_if_open(("li",), SPECIAL - {"address", "div", "p", "li"})
        elif tag in ("dd", "dt"):
            close_if_open(("dd", "dt"), SPECIAL - {"address", "div", "p", "dd", "dt"})
        elif tag in HEADINGS:
            if stack and stack[-1].tag in HEADINGS:
                pop()
        elif tag in ("option", "optgroup"):
            if stack and stack[-1].tag == "option":
                pop()
            if tag == "optgroup" and stack and stack[-1].tag == "optgroup":
                pop()
        elif tag == "button":
            close_if_open(("button",), SCOPE_LIMIT - {"button"})
        elif tag in ("td", "th"):
            close_if_open(("td", "th"), ("table", "template"))
        elif tag == "tr":
            close_if_open(("tr",), ("table", "template"))
        elif tag in ("tbody", "thead", "tfoot"):
            close_if_open(("tbody", "thead", "tfoot"), ("table", "template"))
        elif tag == "a":
            close_if_open(("a",), SCOPE_LIMIT)
        elif tag == "body":
            close_if_open(("head",), ())

    def end_tag(tag: str):
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in FORMATTING:
            i = find_open((tag,), SCOPE_LIMIT)
            if i < 0:
                return
            if last_open(SPECIAL) > stack[i].number:
                finish(stack[i], False)
                del stack[i]
            else:
                close_through(i)
        elif tag in HEADINGS:
            close_if_open(HEADINGS, SCOPE_LIMIT - {"button"})
        elif tag in SPECIAL:
            limits = ("table", "template") if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else (
                SCOPE_LIMIT - {tag}
            )
            if tag == "table":
                limits = ("template",)
            elif tag == "li":
                limits = SCOPE_LIMIT | {"ol", "ul"}
            close_if_open((tag,), limits)
        else:
            close_if_open((tag,), SPECIAL)

    pos, size = 0, len(source)
    while pos < size:
        if complete:
            yield from complete
            complete.clear()
        m = _TAG.search(source, pos)
        if m is None:
            chunks.append(html.unescape(source[pos:]))
            break
        if m.start() > pos:
            chunks.append(html.unescape(source[pos : m.start()]))
        if m.group(1):
            if source.startswith((">", "->"), m.end()):
                pos = source.index(">", m.end()) + 1
                continue
            end = _COMMENT_END.search(source, m.end())
            pos = end.end() if end else size
            continue
        if m.group(4):
            end = source.find(">", m.end())
            pos = size if end < 0 else end + 1
            continue
        closing, tag = m.group(2), m.group(3).lower()
        attrs: dict[str, str] = {}
        pos = m.end()
        finished = self_closed = False
        while True:
            a = _ATTRIBUTE.match(source, pos)
            if a is None:
                break
            if a.group(1):
                self_closed = a.group().rstrip(">").endswith("/")
                pos, finished = a.end(), True
                break
            name = a.group(2).lower()
            value = a.group(3)
            if value is None:
                value = a.group(4)
            if value is None:
                value = a.group(5)
            if name not in attrs:
                attrs[name] = _attribute_text(value) if value else ""
            pos = a.end()
        if not finished:
            break
        if closing:
            end_tag(tag)
            continue

        make_room(tag)
        parent = stack[-1] if stack else None
        count += 1
        elem_id = count
        scope = elem_id if "itemscope" in attrs else (parent.scope if parent else None)
        vocab = attrs.get("vocab") or (parent.vocab if parent else None)
        above = parent.typed if parent else None
        has_id = attrs.get("id")
        id_first = bool(has_id) and has_id not in seen_ids
        if id_first:
            seen_ids.add(has_id)
        if links_only:
            wanted = tag == "a" and bool(attrs.get("href"))
        elif keep == "scripts":
            wanted = tag == "script"
        else:
            wanted = (
                keep == "all"
                or tag == "script"
                or has_id == "__NEXT_DATA__"
                or "itemprop" in attrs
                or "itemscope" in attrs
                or "typeof" in attrs
                or "property" in attrs
            )
        row = None
        if wanted:
            row = {
                "elem_id": elem_id,
                "parent_id": parent.row["elem_id"] if parent and parent.row else None,
                "end_id": elem_id,
                "depth": len(stack),
                "tag": tag,
                "attrs": list(attrs.items()),
                "text": None,
                "raw": None,
                "scope_id": scope,
                "vocab": vocab,
                "typed_ids": _chained(above) if "property" in attrs else None,
                "id_first": id_first,
            }
        wants_text = (
            row is not None
            and not links_only
            and (
                "itemprop" in attrs
                or "property" in attrs
                or has_id == "__NEXT_DATA__"
                or (keep == "all" and tag in ("a", "title"))
            )
        )
        if tag in VOID or (self_closed and foreign):
            if wants_text:
                row["text"] = ""
            if row is not None:
                complete.append(row)
            continue
        typed = (elem_id, above) if "typeof" in attrs else above
        stack.append(_Open(elem_id, row, tag, len(chunks), wants_text, scope, vocab, typed))
        open_at.setdefault(tag, []).append(elem_id)
        if tag in ("svg", "math"):
            foreign += 1
        if tag in _RAW_END:
            end = _RAW_END[tag].search(source, pos)
            body = source[pos : end.start()] if end else source[pos:]
            if tag in ESCAPABLE_TEXT:
                body = html.unescape(body)
            elif row is not None:
                row["raw"] = body
            chunks.append(body)
            pos = end.start() if end else size
            pop()
            if end:
                closed = source.find(">", pos)
                pos = size if closed < 0 else closed + 1
        elif tag == "plaintext":
            chunks.append(source[pos:])
            break
    while stack:
        yield from complete
        complete.clear()
        pop()
    yield from complete


def _chained(typed: tuple | None) -> list[int]:
    """The elements of a chain, outermost first."""
    out = []
    while typed is not None:
        number, typed = typed
        out.append(number)
    return out[::-1]


def html_elements(
    pages: DataFrame,
    key: str = "page_id",
    keep: str = "marked",
    carry: Sequence[str] = (),
    carry_on: str = "document",
    also: Sequence[str] = (),
) -> DataFrame:
    """Element rows of `pages(key, html)`.

    Every page also gives one row with tag `#document`. It holds the `carry` columns
    (with `carry_on="all"` every row of the page does), so pages without elements stay in the table and need no later join. With
    `keep="marked"` a page without any trace of structured data is not handed to the
    parser. Each row says where it stands in the tree: its parent among kept elements,
    the last element inside it, its nearest `itemscope`, the `vocab` in force, and the
    `typeof` elements around a `property`. The columns `also` stand beside the key, in every row.
    """
    markup: Column = F.col("html")
    if keep == "marked":
        markup = F.when(markup.rlike(MARKED_PAGE), markup)
    elif keep == "links":
        markup = F.when(F.lower(markup).contains("href"), markup)
    elif keep == "scripts":
        markup = F.when(F.lower(markup).contains("<script"), markup)
    source = pages.select(key, *also, *carry, markup.alias("html"))
    schema = T.StructType(
        [
            source.schema[key],
            *[source.schema[c] for c in also],
            *ELEMENT_FIELDS,
            *[T.StructField(c, source.schema[c].dataType) for c in carry],
        ]
    )
    arrow_fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]
    names = [f.name for f in ELEMENT_FIELDS]
    everywhere = carry_on == "all"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(c).to_pylist() for c in (key, *also, *carry)}
            columns: dict[str, list] = {name: [] for name, _ in arrow_fields}
            held = 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[name], kind) for name, kind in arrow_fields],
                    names=[name for name, _ in arrow_fields],
                )

            for i, page in enumerate(batch.column("html")):
                text = page.as_py()
                document = {"elem_id": 0, "depth": -1, "tag": "#document"}
                for row in chain((document,), closed_elements(text, keep) if text else ()):
                    for c in (key, *also):
                        columns[c].append(given[c][i])
                    for name in names:
                        columns[name].append(row.get(name))
                    for c in carry:
                        columns[c].append(given[c][i] if everywhere or row is document else None)
                    held += len(row.get("raw") or "") + len(row.get("text") or "") + 100
                    if held > 4_000_000:
                        yield flush()
                        held = 0
                        for values in columns.values():
                            values.clear()
            if columns[key]:
                yield flush()

    return source.mapInArrow(parse, schema)
