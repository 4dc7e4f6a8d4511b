"""URL checks and resolution as column expressions.

Covers special schemes (http, https, ws, wss, ftp, file), relative references, dot
segments, default ports and percent-encoding. Hosts are lower-cased; internationalised
host names are not mapped and percent-encoded hosts count as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.plan import settled

# Characters stripped around a URL, schemes with an authority, and the
# percent-encode sets of path, query and fragment.
C0_AND_SPACE = "".join(map(chr, range(0x21)))
HOST_SCHEMES = ("http", "https", "ws", "wss", "ftp")
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
PATH_ENCODE = r'\x00-\x20"#<>?^`{}\x7f-\x{10ffff}'
QUERY_ENCODE = r"""\x00-\x20"#<>'\x7f-\x{10ffff}"""
FRAGMENT_ENCODE = r'\x00-\x20"<>`\x7f-\x{10ffff}'

# Messages of the URL check.
MUST_BE_TEXT = "URL must be a non-empty string"
INVALID_FORMAT = "Invalid URL format"
DATA_BLOCKED = "data: URLs are not supported for security reasons (prevents DoS attacks)"
UNSUPPORTED = "Protocol '%s' is not supported. Only HTTP, HTTPS, and file: URLs are allowed"
INPUT_MUST_BE_LIST = "Input must be an array of URLs"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"(?:\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+)"
_AUTHORITY = r"^(?:[^/?#\\]*@)?" + _HOST + r"(?::[0-9]*)?$"


def cleaned(url: Column) -> Column:
    return F.translate(F.btrim(url, F.lit(C0_AND_SPACE)), "\t\n\r", "")


def scheme_of(url: Column) -> Column:
    """Lower-case scheme of a cleaned URL, empty when there is none."""
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(url, _SCHEME, "")


def _authority_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[/\\]*([^/\\?#]*)", 1)


def authority_is_valid(authority: Column) -> Column:
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    return authority.rlike(_AUTHORITY) & (
        (port == "") | (F.coalesce(port.try_cast("bigint"), F.lit(65536)) <= 65535)
    )


def is_absolute_valid(url: Column) -> Column:
    """Whether a cleaned URL stands on its own."""
    scheme = scheme_of(url)
    return (
        F.when(url.isNull() | (scheme == ""), False)
        .when(scheme.isin(*HOST_SCHEMES), authority_is_valid(_authority_of(_after_scheme(url))))
        .otherwise(True)
    )


def is_resolvable(reference: Column, base: Column) -> Column:
    """Whether `reference` resolves against `base`; usable inside array functions."""
    ref, root = cleaned(reference), cleaned(base)
    scheme = scheme_of(ref)
    rest = _after_scheme(ref)
    relative = (scheme == "") | ((scheme == scheme_of(root)) & ~rest.rlike(r"^[/\\]{2}"))
    return F.coalesce(
        is_absolute_valid(root)
        & F.when(
            relative,
            F.when(rest.rlike(r"^[/\\]{2}"), authority_is_valid(_authority_of(rest))).otherwise(True),
        )
        .when(scheme.isin(*HOST_SCHEMES), authority_is_valid(_authority_of(rest)))
        .otherwise(True),
        F.lit(False),
    )


#: A path from the root without white space, which resolves wherever the base is sound.
PLAIN_PATH = r"\A/(?![/\\])[!-~]*\z"


def resolvable_among(references: Column, base: Column) -> Column:
    """Those of an array that resolve against `base`. The base is looked at once, and most
    references only as far as `PLAIN_PATH` goes: an index can list millions."""
    kept = F.filter(references, lambda r: r.rlike(PLAIN_PATH) | is_resolvable(r, base))
    return F.when(is_resolvable(F.lit("/"), base), kept).otherwise(F.slice(references, 1, 0))


def validate_url(url: Column) -> Column:
    """STRUCT<is_valid, error, protocol> for one URL."""
    text = cleaned(url)
    scheme = scheme_of(text)
    protocol = F.concat(scheme, F.lit(":"))

    def outcome(valid: bool, error, known) -> Column:
        return F.struct(
            F.lit(valid).alias("is_valid"),
            (error if isinstance(error, Column) else F.lit(error).cast("string")).alias("error"),
            (known if isinstance(known, Column) else F.lit(known).cast("string")).alias("protocol"),
        )

    prefix, suffix = UNSUPPORTED.split("%s")
    unsupported = F.concat(F.lit(prefix), protocol, F.lit(suffix))
    return (
        F.when(url.isNull() | (url == ""), outcome(False, MUST_BE_TEXT, None))
        .when(~is_absolute_valid(text), outcome(False, INVALID_FORMAT, None))
        .when(scheme == "data", outcome(False, DATA_BLOCKED, protocol))
        .when(~scheme.isin("http", "https", "file"), outcome(False, unsupported, protocol))
        .otherwise(outcome(True, None, protocol))
    )


def validate_urls(urls: Column) -> Column:
    """The check over an array of URLs; an absent array gives the one fixed error."""
    absent = F.array(
        F.struct(
            F.lit(False).alias("is_valid"),
            F.lit(INPUT_MUST_BE_LIST).alias("error"),
            F.lit(None).cast("string").alias("protocol"),
        )
    )
    return F.when(urls.isNull(), absent).otherwise(F.transform(urls, validate_url))


def _host_of(authority: Column) -> Column:
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1))


def domain_of(url: Column) -> Column:
    """Host name without a leading `www.`; `output` when the URL is not valid."""
    text = cleaned(url)
    rest = _after_scheme(text)
    host = F.when(
        scheme_of(text).isin(*HOST_SCHEMES), _host_of(_authority_of(rest))
    ).otherwise(_host_of(F.regexp_extract(rest, r"^//([^/?#]*)", 1)))
    return F.when(
        F.coalesce(is_absolute_valid(text), F.lit(False)), F.regexp_replace(host, r"^www\.", "")
    ).otherwise(F.lit("output"))


def is_internal(url: Column, root: Column) -> Column:
    """Raw prefix test, so `https://a.b` also admits `https://a.b.evil`."""
    return url.startswith(root)


def percent_encoded(text: Column, encode_set: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{encode_set}]+|[^{encode_set}]+"), 0)
    return F.when(
        text.rlike(f"[{encode_set}]"),
        F.array_join(
            F.transform(
                runs,
                lambda r: F.when(
                    r.rlike(f"^[{encode_set}]"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
                ).otherwise(r),
            ),
            "",
        ),
    ).otherwise(text)


def _without_dot_segments(path: Column) -> Column:
    up = (F.lit(".."), F.lit(".%2e"), F.lit("%2e."), F.lit("%2e%2e"))
    here = (F.lit("."), F.lit("%2e"))
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            F.lower(s).isin(*up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(F.lower(s).isin(*here), done)
        .otherwise(F.array_append(done, s)),
    )
    ends_in_dots = F.lower(path).rlike(r"/(?:\.|%2e){1,2}$")
    joined = F.concat(
        F.lit("/"), F.array_join(F.when(ends_in_dots, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    )
    return F.when(F.lower(path).rlike(r"/(?:\.|%2e){1,2}(?:/|$)"), joined).otherwise(path)


#: A root of lower case without port or path, and a path from there without dots at the start of a
#: name or anything to encode: the one after the other is what they resolve to.
PLAIN_ROOT = r"\Ahttps?://[a-z0-9]+(?:[.\-][a-z0-9]+)*\z"
PLAIN_NAMES = r"\A/(?:[A-Za-z0-9_~\-][A-Za-z0-9_~.\-]*+(?:/|\z))*+\z"


def with_resolved_url(df: DataFrame, reference: str, base: str, out: str) -> DataFrame:
    """Add `out`: `reference` as an absolute URL, NULL where it does not resolve. Plain ones,
    nearly all that an index lists, are not taken apart: what does that gets NULL for them."""
    plain = F.col(base).rlike(PLAIN_ROOT) & F.col(reference).rlike(PLAIN_NAMES)
    df = settled(df.withColumn("_joined", F.when(plain, F.concat(base, reference))), "_joined")
    rest = F.col("_joined").isNull()
    df = df.withColumns({"_s": cleaned(F.when(rest, F.col(reference))), "_b": cleaned(F.when(rest, F.col(base)))})
    df = df.withColumns(
        {
            "_scheme": scheme_of(F.col("_s")),
            "_base_scheme": scheme_of(F.col("_b")),
            "_rest": _after_scheme(F.col("_s")),
            "_base_rest": _after_scheme(F.col("_b")),
            "_ok": is_resolvable(F.col("_s"), F.col("_b")),
        }
    )
    relative = (F.col("_scheme") == "") | (
        (F.col("_scheme") == F.col("_base_scheme"))
        & F.col("_scheme").isin(*HOST_SCHEMES)
        & ~F.col("_rest").rlike(r"^[/\\]{2}")
    )
    before_hash = F.regexp_extract("_rest", r"(?s)^([^#]*)", 1)
    df = df.withColumns(
        {
            "_relative": relative,
            "_fragment": F.regexp_extract("_rest", r"(?s)^[^#]*(#.*)?$", 1),
            "_query": F.regexp_extract(before_hash, r"(?s)^[^?]*(\?.*)?$", 1),
            "_path": F.replace(
                F.regexp_extract(before_hash, r"(?s)^([^?]*)", 1), F.lit("\\"), F.lit("/")
            ),
            "_base_authority": _authority_of(F.col("_base_rest")),
            "_base_path": F.regexp_extract("_base_rest", r"^[/\\]*[^/\\?#]*([^?#]*)", 1),
            "_base_query": F.regexp_extract("_base_rest", r"^[^?#]*(\?[^#]*)?", 1),
        }
    )
    is_file = ~F.col("_relative") & (F.col("_scheme") == "file")
    own_authority = ~F.col("_relative") | F.col("_path").startswith("//")
    directory = F.regexp_replace(
        F.when(F.col("_base_path") == "", "/").otherwise(F.col("_base_path")), r"[^/]*$", ""
    )
    df = df.withColumns(
        {
            "_out_scheme": F.when(F.col("_relative"), F.col("_base_scheme")).otherwise(F.col("_scheme")),
            "_authority": F.when(is_file, F.regexp_extract("_path", r"^//([^/]*)", 1))
            .when(own_authority, _authority_of(F.col("_path")))
            .otherwise(F.col("_base_authority")),
            "_raw_path": F.when(is_file, F.regexp_replace("_path", r"^//[^/]*", ""))
            .when(own_authority, F.regexp_extract("_path", r"^/*[^/]*(.*)$", 1))
            .when(F.col("_path") == "", F.col("_base_path"))
            .when(F.col("_path").startswith("/"), F.col("_path"))
            .otherwise(F.concat(directory, F.col("_path"))),
            "_raw_query": F.when(
                F.col("_relative") & (F.col("_path") == "") & (F.col("_query") == ""),
                F.col("_base_query"),
            ).otherwise(F.col("_query")),
        }
    )
    bare = F.regexp_replace("_authority", r"^.*@", "")
    port = F.regexp_replace(F.regexp_extract(bare, r":([0-9]*)$", 1), r"^0+(?=[0-9])", "")
    default_port = F.coalesce(
        F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[F.col("_out_scheme")],
        F.lit(""),
    )
    host = F.concat(
        F.regexp_extract("_authority", r"^(.*@)", 1),
        _host_of(F.col("_authority")),
        F.when((port == "") | (port == default_port), "").otherwise(F.concat(F.lit(":"), port)),
    )
    path = F.when(F.col("_raw_path").startswith("/"), F.col("_raw_path")).otherwise(
        F.concat(F.lit("/"), F.col("_raw_path"))
    )
    with_host = F.concat(
        F.col("_out_scheme"),
        F.lit("://"),
        host,
        percent_encoded(_without_dot_segments(path), PATH_ENCODE),
        percent_encoded(F.col("_raw_query"), QUERY_ENCODE),
        percent_encoded(F.col("_fragment"), FRAGMENT_ENCODE),
    )
    opaque = F.concat(F.col("_scheme"), F.lit(":"), F.col("_rest"))
    special = F.col("_out_scheme").isin(*HOST_SCHEMES, "file")
    resolved = F.when(F.col("_ok"), F.when(special, with_host).otherwise(opaque))
    df = df.withColumn(out, F.when(F.col("_joined").isNotNull(), F.col("_joined")).otherwise(resolved))
    return settled(df.drop(*_WORK_COLUMNS), out)


_WORK_COLUMNS = (
    "_joined", "_s", "_b", "_scheme", "_base_scheme", "_rest", "_base_rest", "_ok", "_relative",
    "_fragment", "_query", "_path", "_base_authority", "_base_path", "_base_query",
    "_out_scheme", "_authority", "_raw_path", "_raw_query",
)
