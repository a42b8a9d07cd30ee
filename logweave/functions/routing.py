"""Routing, names and ids of shards as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SHARDS = 16
#: Fixed values of 32-bit FNV-1a: offset basis, prime, mask.
_BASIS, _PRIME, _MASK = 2166136261, 16777619, 4294967295


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the key's UTF-8 bytes, as a long; a null key counts as empty. Each step fits into 63 bits."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(_PRIME).cast("long")).bitwiseAND(F.lit(_MASK).cast("long"))
    begin, size = F.lit(_BASIS).cast("long"), F.octet_length(text)
    places = F.filter(F.sequence(F.lit(0), size), lambda i: i > 0)
    # one character is one byte in most keys; the others go through their bytes' digits
    plain = F.aggregate(places, begin, lambda h, i: step(h, F.ascii(F.substring(text, i, F.lit(1))).cast("long")))
    digits = F.hex(text.cast("binary"))
    other = F.aggregate(places, begin, lambda h, i: step(h, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")))
    return F.when(size == F.length(text), plain).otherwise(other)


def pick_shard(key: Column, shards: int = 0) -> Column:
    """The key's shard; 0 shards count as 16."""
    return F.pmod(fnv1a(key), F.lit(shards or DEFAULT_SHARDS).cast("long")).cast("int")


def owned_ids(shards: int, process: int, processes: int) -> list[int]:
    return [s for s in range(shards or DEFAULT_SHARDS) if processes <= 1 or s % processes == process]


def pick_owned_shard(key: Column, shards: int, process: int, processes: int) -> Column:
    """The key's shard among those that this process owns; it is an error to own none."""
    own = owned_ids(shards, process, processes)
    if not own:
        raise ValueError(f"process {process} of {processes} owns none of {shards} shards")
    return F.get(F.array(*map(F.lit, own)), F.pmod(fnv1a(key), F.lit(len(own)).cast("long")).cast("int")).cast("int")


def owns(shard: Column, process: int, processes: int) -> Column:
    return F.lit(True) if processes <= 1 else F.pmod(shard, F.lit(processes)) == process


def stream_name(prefix: str, shard: Column) -> Column:
    return F.format_string("%s:%04d", F.lit(prefix), shard)


def streams(prefix: str, shards: int = 0) -> list[str]:
    """The names of all shards' streams, in order; 0 shards count as 16."""
    return [f"{prefix}:{s:04d}" for s in range(shards or DEFAULT_SHARDS)]


def pick_stream(prefix: str, key: Column, shards: int = 0) -> Column:
    return stream_name(prefix, pick_shard(key, shards))


#: Fixed values of the offset table's slots: how many, and how many bytes of a group's name a slot holds.
SLOTS, NAME = 512, 47


def slot_name(group: Column) -> Column:
    """A group's name as a slot holds it: up to its first zero byte, at most 47 bytes."""
    return F.substring(F.split(group, "\u0000").getItem(0).cast("binary"), 1, NAME).cast("string")


def slot(group: Column) -> Column:
    """The slot where the search for a group begins; further ones follow it."""
    return F.pmod(fnv1a(group), F.lit(SLOTS).cast("long")).cast("int")


def parse_stream(name: Column) -> Column:
    """The shard in a stream's name: after ``:shard:`` any decimal, else exactly four digits at the end; null for others."""
    long, four = F.regexp_extract(name, r":shard:(\d+)$", 1), F.regexp_extract(name, r":(\d{4})$", 1)
    return F.when(long != "", long).when(four != "", four).try_cast("bigint")


def message_id(shard: Column, entry: Column) -> Column:
    return F.concat_ws("-", shard.cast("string"), entry.cast("string"))


def parse_message_id(text: Column) -> Column:
    """struct<shard_id, entry_number>; null for what is not an id."""
    shard, entry = (F.regexp_extract(text, r"^(\d+)-(-?\d+)$", i).try_cast("bigint") for i in (1, 2))
    return F.when(shard.isNotNull() & entry.isNotNull(), F.struct(shard.alias("shard_id"), entry.alias("entry_number")))
