"""Lists that an organisation keeps: allowlists, brands, owned domains, zones, feedback."""

from __future__ import annotations

import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirefold.functions import text as tx

_LABELS = r"^[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?(?:\.[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)+$"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where(~F.col("line").rlike("^(?:#|$)"))


def allowlist_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """(kind, value): domain or ip, each once, of lines with an optional prefix "domain:" or "ip:"; blank lines and comments are none."""
    low = F.lower(F.trim(line))
    named = F.regexp_extract(low, r"^(domain|ip):", 1)
    value = F.trim(F.regexp_replace(low, r"^(?:domain|ip):", ""))
    address = value.rlike(rf"^{tx.IPV4}(?:/\d+)?$") | (F.length(value) - F.length(F.replace(value, F.lit(":"))) >= 2)
    kind = F.when(named != "", named).when(address, "ip").otherwise("domain")
    bare = F.when(kind == "domain", F.regexp_replace(value, r"\.+$", "")).otherwise(value)
    return lines.where(~F.coalesce(F.trim(line), F.lit("")).rlike("^(?:#|$)")).select(kind.alias("kind"), bare.alias("value")).where("value <> ''").distinct()


def new_allowlist_lines(entries: DataFrame, value: str, known: DataFrame) -> DataFrame:
    """Lines to append to an allowlist: hosts of entries (URLs and addresses are reduced to theirs) that known(kind, value) doesn't have."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"\.+$", "")
    host = F.when((F.instr(low, "@") > 0) & (F.instr(low, "://") == 0), F.substring_index(low, "@", -1)).when((F.instr(low, "://") > 0) | low.startswith("www."), tx.url_host(F.when(F.instr(low, "://") > 0, low).otherwise(F.concat(F.lit("https://"), low)))).otherwise(low)
    found = allowlist_entries(entries.select(host.alias("line")))
    return found.join(known, ["kind", "value"], "left_anti").select(F.concat_ws(":", "kind", "value").alias("line"))


def owned_domains(lines: DataFrame, line: str = "line") -> DataFrame:
    """(domain) of lines that are one well-formed ASCII or Punycode domain; what holds an address, a path or a blank is left out."""
    host = F.regexp_replace(F.lower(F.trim(line)), r"^[@.]+", "")
    return lines.select(host.alias("domain")).where(F.col("domain").rlike(_LABELS) & (F.length("domain") <= 253)).distinct()


def zones(items: Column, most: int = 64) -> Column:
    """Zones with a leading dot, in lower case, each once, at most 64."""
    tidy = F.transform(F.filter(items, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), lambda x: F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim(x)), r"^\.+", "")))
    return F.slice(F.array_distinct(tidy), 1, most)


def recent_feedback(spark: SparkSession, path: str, schema: str, order: str, most: int = 500) -> DataFrame:
    """The last rows of a file of JSON lines by an order column; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(most)


def append_feedback(events: DataFrame, path: str) -> None:
    """Adds events as JSON lines."""
    events.write.mode("append").json(path)


def suggestions_json(changes: DataFrame, name: str, value: str) -> DataFrame:
    """(json): one object of settings and values, in order of the names. Settings are a fixed, small set."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v"))))
    return changes.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def unpack_profile(archive: str, folder: str) -> list[str]:
    """Files of a profile pack; a member that leads out of the folder is an error and nothing is written."""
    base = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        names = [i for i in z.infolist() if not i.is_dir()]
        for i in names:
            name = i.filename.replace("\\", "/")
            if PurePosixPath(name).is_absolute() or ".." in PurePosixPath(name).parts or not (base / name).resolve().is_relative_to(base):
                raise ValueError(f"{i.filename} leads out of the folder")
        for i in names:
            target = base / i.filename.replace("\\", "/")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(z.read(i))
        return sorted(i.filename for i in names)
