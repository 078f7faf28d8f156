"""JSON objects as arrays of nodes, and lookups over them.

`json_nodes` is the only Python step: it lists the nodes of one JSON object in
document order with keys sorted. Every lookup below is a column expression over that
array.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("path", "parent", "key")]
    + [T.StructField("depth", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in ("kind", "text")]
    + [T.StructField("size", T.LongType())]
)
NODES = T.ArrayType(NODE)

FAILURE_WORDS = ("error", "failed", "failure")


def _reject(token):
    raise ValueError(token)


def _number(value: int | float) -> str:
    """Shortest form of a double: 1.0 and 1 are both `1`; exponents only below 1e-6 and from 1e21 on."""
    if type(value) is int and -(2**53) < value < 2**53:
        return str(value)
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        return json.dumps(value)
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, exponent = repr(value).split("e")
    mantissa = mantissa.removesuffix(".0")
    return f"{mantissa}e{exponent[0]}{exponent[1:].lstrip('0')}"


def _walk(value, path, parent, key, depth, out):
    """Append the node of `value` and those below it to the seven columns of `out`; its size."""
    paths, parents, keys, depths, kinds, texts, sizes = out
    at = len(paths)
    paths.append(path)
    parents.append(parent)
    keys.append(key)
    depths.append(depth)
    text = None
    if isinstance(value, str):
        kind, text = "string", value
        size = len(value) if value.isascii() else len(value.encode("utf-8", "surrogatepass"))
    elif isinstance(value, dict):
        kind, size = "object", 0
    elif isinstance(value, list):
        kind, size = "array", 0
    else:
        plain = value is None or isinstance(value, bool)
        text = json.dumps(value) if plain else _number(value)
        kind = "null" if value is None else "bool" if plain else "number"
        size = len(text)
    kinds.append(kind)
    texts.append(text)
    sizes.append(size)
    if kind == "object":
        for name in sorted(value):
            step = name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name
            size += _walk(value[name], f"{path}/{step}", path, name, depth + 1, out)
        sizes[at] = size
    elif kind == "array":
        for i, item in enumerate(value):
            size += _walk(item, f"{path}/{i}", path, None, depth + 1, out)
        sizes[at] = size
    return size


def json_nodes(lines: Column | str) -> Column:
    """Nodes of a JSON object; NULL where the text is not one. Text that begins no object stays with Spark."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    return _object_nodes(F.when(lines.rlike(r"^\s*\{"), lines))


@F.arrow_udf(NODES)
def _object_nodes(lines: pa.Array) -> pa.Array:
    columns = [[] for _ in range(7)]
    offsets, valid = [0], []
    for line in lines.to_pylist():
        ok = False
        if line is not None and line.lstrip()[:1] == "{":
            try:
                _walk(json.loads(line, parse_constant=_reject), "", None, None, 0, columns)
                ok = True
            except (ValueError, RecursionError):
                for column in columns:
                    del column[offsets[-1] :]
        offsets.append(len(columns[0]))
        valid.append(ok)
    types = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2 + [pa.int64()]
    names = ["path", "parent", "key", "depth", "kind", "text", "size"]

    def clean(items, kind):
        try:
            return pa.array(items, type=kind)
        except UnicodeEncodeError:  # half of a surrogate pair
            items = [None if s is None else s.encode("utf-8", "replace").decode("utf-8") for s in items]
            return pa.array(items, type=kind)

    struct = pa.StructArray.from_arrays(
        [clean(c, t) for c, t in zip(columns, types)],
        fields=[pa.field(n, t) for n, t in zip(names, types)],
    )
    return pa.ListArray.from_arrays(
        pa.array(offsets, type=pa.int32()),
        struct,
        mask=pa.array([not v for v in valid], type=pa.bool_()),
    )


# Root under which the nodes of a JSON object held in a string are kept.
INNER = "#"

# Keys that are looked up at any depth.
DEEP_KEYS = (
    "role", "type", "kind", "parentuuid", "parentid", "parent_id", "name", "tool", "command",
    "error", "is_error", "method", "params", "result", "output", "tool_response", "payload",
    "item", "state", "enabledmcptools", "toolcall", "last_token_usage",
    "input_tokens", "prompt_tokens", "cache_read_input_tokens", "cached_input_tokens",
    "cache_creation_input_tokens", "output_tokens", "completion_tokens",
    "lines_added", "additions", "lines_removed", "deletions", "removals",
)


@dataclass(frozen=True)
class Doc:
    """One parsed object: its nodes and two lookups by path, all plain columns."""

    nodes: Column
    strings: Column  # path -> trimmed, non-blank string
    sizes: Column  # path -> bytes, for every node
    keyed: Column  # the nodes whose key is one of DEEP_KEYS


def settled(df, columns: dict[str, Column]):
    """Add columns through a one-row generator.

    The optimizer does not copy expressions across a generator, so whatever refers to
    these columns later reads the value instead of a copy of the expression.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_doc(df, nodes: str, prefix: str):
    """Add the lookup columns of `nodes` and return (frame, Doc)."""
    n = F.col(nodes)
    text = F.filter(n, lambda x: (x["kind"] == "string") & x["text"].rlike(r"\S"))
    df = settled(
        df,
        {
            f"{prefix}strings": F.map_from_entries(
                F.transform(
                    text,
                    lambda x: F.struct(
                        x["path"], F.regexp_replace(x["text"], r"^\s+|\s+$", "").alias("t")
                    ),
                )
            ),
            f"{prefix}sizes": F.map_from_entries(
                F.transform(n, lambda x: F.struct(x["path"], x["size"]))
            ),
            f"{prefix}keyed": F.filter(
                n,
                lambda x: F.lower(x["key"]).isin(*DEEP_KEYS) & ~x["path"].startswith(INNER),
            ),
        },
    )
    doc = Doc(n, *[F.col(prefix + name) for name in ("strings", "sizes", "keyed")])
    return df, doc


def _pick(nodes: Column, test) -> Column:
    return F.try_element_at(F.filter(nodes, test), F.lit(1))


def at(root, key: str) -> Column:
    """Path of the direct key under `root` ('' or a path column)."""
    step = "/" + key.replace("~", "~0").replace("/", "~1")
    return F.lit(root + step) if isinstance(root, str) else F.concat(root, F.lit(step))


def _below(node: Column, root) -> Column:
    return node["path"].startswith(F.concat(root, F.lit("/")))


def _deep(doc: Doc, key: str, root, *tests, any_case: bool = True) -> Column:
    """Nodes of this key below `root` that pass the tests, in document order."""

    def wanted(n):
        ok = (F.lower(n["key"]) == key.lower()) if any_case else (n["key"] == key)
        for test in tests:
            ok = ok & test(n)
        return ok if isinstance(root, str) else ok & _below(n, root)

    return F.filter(doc.keyed, wanted)


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def direct_string(doc: Doc, *keys: str, root="") -> Column:
    """First non-blank string among the direct keys, trimmed; ''."""
    return F.coalesce(*[F.try_element_at(doc.strings, at(root, k)) for k in keys], F.lit(""))


def first_present(doc: Doc, *keys: str, root="") -> Column:
    """Path of the first direct key that exists; NULL."""
    return F.coalesce(
        *[F.when(F.map_contains_key(doc.sizes, at(root, k)), at(root, k)) for k in keys]
    )


def subtree(nodes: Column, root: Column) -> Column:
    """The node at `root` and all below it, re-rooted."""
    cut = F.length(root) + 1
    return F.transform(
        F.filter(nodes, lambda n: (n["path"] == root) | _below(n, root)),
        lambda n: n.withField("path", F.substr(n["path"], cut)).withField(
            "parent", F.when(n["path"] != root, F.substr(n["parent"], cut))
        ),
    )


def _is_text(n: Column) -> Column:
    return (n["kind"] == "string") & (n["text"] != "")


def first_string(doc: Doc, key: str, root="") -> Column:
    """First non-empty string under this key at any depth; ''."""
    found = _deep(doc, key, root, _is_text, any_case=False)
    return F.coalesce(_first(found)["text"], F.lit(""))


def any_true(doc: Doc, key: str) -> Column:
    return F.size(_deep(doc, key, "", lambda n: n["text"] == "true", any_case=False)) > 0


def _whole(text: Column) -> Column:
    return text.try_cast("double").try_cast("long")


def first_int(doc: Doc, key: str, root="") -> Column:
    """First non-zero number under this key (any case), cut towards zero; 0."""
    found = _deep(
        doc, key, root, lambda n: (n["kind"] == "number") & (_whole(n["text"]) != 0)
    )
    return F.coalesce(_whole(_first(found)["text"]), F.lit(0).cast("long"))


def first_object(doc: Doc, key: str, root="") -> Column:
    """Path of the first object under this key (any case); NULL."""
    return _first(_deep(doc, key, root, lambda n: n["kind"] == "object"))["path"]


def first_value(doc: Doc, key: str, root="") -> Column:
    """Path of the first non-null value under this key (any case); NULL."""
    return _first(_deep(doc, key, root, lambda n: n["kind"] != "null"))["path"]


def has_value(doc: Doc, key: str, root="") -> Column:
    return F.coalesce(
        F.size(_deep(doc, key, root, lambda n: n["kind"] != "null")) > 0, F.lit(False)
    )


def size_at(doc: Doc, path: Column) -> Column:
    return F.coalesce(F.try_element_at(doc.sizes, path), F.lit(0).cast("long"))


def type_contains(doc: Doc, needle: str) -> Column:
    found = _deep(
        doc,
        "type",
        "",
        lambda n: (n["kind"] == "string") & F.lower(n["text"]).contains(needle.lower()),
        any_case=False,
    )
    return F.size(found) > 0


def flat_text(nodes: Column, max_bytes: int | None = None) -> Column:
    """All strings in order, joined by blanks; with `max_bytes`, longer ones are cut and marked."""

    def cut(n):
        short = F.concat(
            F.decode(F.substring(F.encode(n["text"], "UTF-8"), 1, max_bytes), "UTF-8"),
            F.lit(" [truncated]"),
        )
        return F.when(F.octet_length(n["text"]) > max_bytes, short).otherwise(n["text"])

    strings = F.filter(nodes, lambda n: n["kind"] == "string")
    return F.array_join(F.transform(strings, (lambda n: n["text"]) if max_bytes is None else cut), " ")


def has_error(doc: Doc, root="") -> Column:
    """A true or non-empty error key, or a string that is nothing but a failure word."""

    def bad(n):
        flagged = F.lower(n["key"]).isin("is_error", "error") & (
            (n["text"] == "true") & (n["kind"] == "bool") | _is_text(n)
        )
        said = (n["kind"] == "string") & F.lower(n["text"]).isin(*FAILURE_WORDS)
        found = F.coalesce(flagged, F.lit(False)) | F.coalesce(said, F.lit(False))
        return found if isinstance(root, str) else found & _below(n, root)

    return F.coalesce(F.exists(doc.nodes, bad), F.lit(False))


def value_hash(doc: Doc, path: Column) -> Column:
    """16 hex digits, equal exactly when the JSON values at `path` are equal; ''.

    Serves comparison only: the digest is taken over the sorted node list.
    """
    value = F.transform(
        F.filter(doc.nodes, lambda n: (n["path"] == path) | _below(n, path)),
        lambda n: F.concat_ws(
            "\x01",
            F.substr(n["path"], F.length(path) + 1),
            n["kind"],
            F.coalesce(n["text"], F.lit("")),
        ),
    )
    joined = F.nullif(F.array_join(value, "\x02"), F.lit("\x01null\x01null"))
    return F.when(path.isNull(), "").otherwise(
        F.coalesce(F.substring(F.sha2(joined, 256), 1, 16), F.lit(""))
    )


def output_bytes(doc: Doc, root="") -> Column:
    """Bytes of the output-like direct keys and of `state`; of everything if none."""
    total = size_at(doc, at(root, "output"))
    for key in ("content", "result", "tool_output"):
        total = total + size_at(doc, at(root, key))
    state = first_object(doc, "state", root)
    total = total + size_at(doc, at(state, "output")) + size_at(doc, at(state, "metadata"))
    whole = size_at(doc, F.lit("") if isinstance(root, str) else root)
    return F.coalesce(F.nullif(total, F.lit(0).cast("long")), whole)


def usage(doc: Doc, last: Column) -> dict[str, Column]:
    """Token counters: the object at `last` wins when it is filled, else the key families."""

    def anyof(*keys):
        total = first_int(doc, keys[0])
        for key in keys[1:]:
            total = total + first_int(doc, key)
        return total

    def own(*keys):
        total = F.lit(0).cast("long")
        for key in keys:
            found = _deep(
                doc, key, "", lambda n: (n["path"] == at(last, key)) & (n["kind"] == "number")
            )
            total = total + F.coalesce(_whole(_first(found)["text"]), F.lit(0).cast("long"))
        return total

    filled = F.coalesce(F.exists(doc.nodes, lambda n: n["parent"] == last), F.lit(False))
    return {
        "tok_in": F.when(filled, own("input_tokens")).otherwise(
            anyof("input_tokens", "prompt_tokens")
        ),
        "tok_cached": F.when(
            filled, own("cached_input_tokens", "cache_read_input_tokens")
        ).otherwise(anyof("cache_read_input_tokens", "cached_input_tokens")),
        "tok_cache_new": F.when(filled, own("cache_creation_input_tokens")).otherwise(
            anyof("cache_creation_input_tokens")
        ),
        "tok_out": F.when(filled, own("output_tokens")).otherwise(
            anyof("output_tokens", "completion_tokens")
        ),
    }


def patch_lines(doc: Doc) -> dict[str, Column]:
    return {
        "patch_add": first_int(doc, "lines_added") + first_int(doc, "additions"),
        "patch_del": first_int(doc, "lines_removed")
        + first_int(doc, "deletions")
        + first_int(doc, "removals"),
    }


def non_empty(nodes: Column) -> Column:
    """Leaves that are neither null nor ''."""
    return F.filter(
        nodes,
        lambda n: n["kind"].isin("number", "bool") | ((n["kind"] == "string") & (n["text"] != "")),
    )
