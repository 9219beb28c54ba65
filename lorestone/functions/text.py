"""Scalar text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of more than one character, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z0-9]+\b"), F.lit(0)), lambda t: F.length(t) > 1)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def truncated(text: Column, max_tokens: int) -> Column:
    """At most four characters a token; a cut falls on the last space if that is beyond 80 % of the limit; a cut text ends in ``...``."""
    limit = 4 * max_tokens
    head = F.substring(text, 1, limit)
    space = limit - F.instr(F.reverse(head), " ")  # characters ahead of the last space; the limit itself if there is none
    at_word = (F.instr(head, " ") > 0) & (space > F.lit(0.8 * limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(at_word, F.substring(head, F.lit(1), space)).otherwise(head), F.lit("...")))


def cost(token_count: Column, price_per_1k: float) -> Column:
    return F.round(token_count * F.lit(price_per_1k) / 1000, 9)


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """The delay before a retry, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(cap))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_id(key: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 as an unsigned 64-bit number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def chunk_id(file: Column, kind: Column, name: Column, chunk_type: Column) -> Column:
    return F.concat_ws("::", file, kind, name, chunk_type)


def relation_id(src: Column, kind: Column, dst: Column, import_type: Column, context: Column) -> Column:
    """Parts that are null are left out."""
    return F.concat_ws("::", src, kind, dst, import_type, context)


def split_name(name: Column) -> Column:
    """Camel case and underscores become spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " "))


def observation_weight(observation: Column) -> Column:
    lower = F.lower(observation)
    heavy = F.lit(False)
    for p in ("class:", "function:", "method:", "interface:", "signature:"):
        heavy = heavy | lower.startswith(p)
    some = F.lit(False)
    for p in ("purpose:", "responsibility:", "description:"):
        some = some | lower.startswith(p)
    return F.when(heavy, 3).when(some, 2).otherwise(1)


def weighted_observations(observations: Column) -> Column:
    """Observations repeated by weight, joined by `` | ``."""
    return F.array_join(F.flatten(F.transform(observations, lambda o: F.array_repeat(o, observation_weight(o)))), " | ")


def plain_text(html: Column) -> Column:
    """Markup, scripts and styles removed; line breaks from br, p and li kept; white space settled."""
    steps = (
        (r"(?s)<\?php.*?\?>", ""),
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p>", "\n\n"),
        (r"(?i)<p[^>]*>", ""),
        (r"(?i)<li[^>]*>", "• "),
        (r"(?i)</li>", "\n"),
        (r"<[^>]+>", ""),
    )
    out = html
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    for name, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(put))
    for pattern, put in ((r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r" +\n", "\n"), (r"\n +", "\n")):
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def encode_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))


def naive_timestamp(value: Column) -> Column:
    """Epoch seconds or ISO text; a zone is dropped without a shift."""
    iso = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"(Z|[+-]\d\d:\d\d)$", ""), "T", " "))
    return F.when(value.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(value.cast("double"))).otherwise(iso).cast("timestamp_ntz")
