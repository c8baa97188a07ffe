"""Hosts and names that resemble a brand."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.functions import text as tx

# Letters that look like a Latin one, by pairs (letter, Latin), in lower case.
CONFUSABLE = "аa еe оo рp сc уy хx іi їi ёe ѕs ɡg ҝk қk үy ұu ңn әa өo һh ґg"
# Longer names and other zones of the same vendor, which are no spoofs.
VENDOR_NAMES = (
    "googlemail", "amazonaws", "office365", "microsoftonline", "facebookmail", "googleapis", "googleusercontent", "githubusercontent", "icloud-content", "googleadservices", "googlevideo",
    "dropboxusercontent", "paypalobjects", "apple-cloudkit", "amazontrust", "googletagmanager", "google-analytics", "githubassets",
)
VENDOR_ZONES = ("yandex.net", "office.net", "github.io")
# Words that after a brand's name make another product's.
PRODUCT_WORDS = (
    "teams", "calendar", "еда", "нефть", "маркет", "notification", "365", "edge", "word", "docs", "drive", "meet", "диск", "музыка", "почта", "прайм", "music", "pay", "инвестиции", "онлайн",
    "gold", "медиа", "страхование", "office", "excel", "outlook", "chrome", "браузер", "бизнес",
)


def _styled() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII character (full-width, mathematical and so on), and that character."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c)).lower()) for a, b in ((0x2100, 0x2150), (0xFF00, 0xFFEF), (0x1D400, 0x1D800)) for c in range(a, b)]
    pairs = [(x, y) for x, y in pairs if len(y) == 1 and y.isascii() and y != x]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


STYLED_FROM, STYLED_TO = _styled()
FOLD_FROM, FOLD_TO = "".join(p[0] for p in CONFUSABLE.split()), "".join(p[1] for p in CONFUSABLE.split())


def folded(c: Column) -> Column:
    """Compatibility forms as plain characters, lower case, letters that look like Latin ones in their place."""
    return F.translate(F.lower(F.translate(c, STYLED_FROM, STYLED_TO)), FOLD_FROM, FOLD_TO)


def unicode_hosts(hosts: DataFrame, host: str) -> DataFrame:
    """hosts with `visible`: labels in Punycode as the letters they stand for; others, and labels that can't be decoded, stay.

    Only hosts with such a label leave the JVM.
    """
    coded = F.coalesce(F.lower(host).contains("xn--"), F.lit(False))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hosts.schema.fields)
    at = hosts.columns.index(host)

    def label(x: str) -> str:
        if not x.startswith("xn--"):
            return x
        try:
            return x[4:].encode("ascii").decode("punycode")
        except (UnicodeError, IndexError, OverflowError):
            return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [".".join(label(x) for x in h.lower().split(".")) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.string())], names=[*b.schema.names, "visible"])

    return hosts.where(~coded).withColumn("visible", F.col(host)).unionByName(hosts.where(coded).mapInArrow(run, f"{schema}, visible string"))


def brand_hits(hosts: DataFrame, host: str, brands: list[str], max_distance: int = 2, decode: bool = True) -> DataFrame:
    """(host, brand, kind, distance) of the distinct hosts that resemble a brand.

    kind: idn (a host with non-ASCII letters or Punycode; no brand), homoglyph
    (equal after folding), brand_spoof (a label of five or more letters inside
    a foreign name) or levenshtein (at most max_distance edits, one for labels
    under five letters and then of equal length). `decode` compares the
    letters that Punycode stands for. The brands are a list of the caller, at
    most 1,000: each distinct host is compared with it in one pass of bounded
    edit distances; for such a list that costs less than the deletion
    neighbourhoods of the hosts (over 100 a host), and there is no join.
    """
    if len(brands) > 1_000:
        raise ValueError("the list of brands must stay small enough for one array")
    parts = [(b, b.lower().split(".")) for b in brands]
    listed = F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(".".join(p[-2:])).alias("reg"), F.lit(p[-2] if len(p) > 1 else p[0]).alias("label")) for b, p in parts])
    one = hosts.select(F.lower(F.regexp_replace(host, r"^\.+|\.+$", "")).alias("host")).where("host like '%.%'").distinct()
    shown = unicode_hosts(one, "host") if decode else one.withColumn("visible", F.col("host"))
    rows = shown.withColumn("own", tx.registrable(F.col("host"))).withColumn("reg", tx.registrable(F.col("visible"))).withColumn("norm", folded(F.col("reg")))
    idn = shown.where(F.col("host").rlike(r"[^\x00-\x7F]|(?:^|\.)xn--")).select("host", F.lit("").alias("brand"), F.lit("idn").alias("kind"), F.lit(None).cast("int").alias("distance"))
    pairs = rows.withColumn("b", F.explode(listed)).where((F.col("reg") != F.col("b.reg")) & (F.col("own") != F.col("b.reg")))
    pairs = pairs.withColumn("label", F.substring_index("norm", ".", 1)).withColumn("seen", F.substring_index("reg", ".", 1)).withColumn("zone", tx.zone_of(F.col("norm")))
    b_norm, b_label = folded(F.col("b.reg")), folded(F.col("b.label"))
    foreign = (F.col("zone") != "") & (F.col("zone") != F.substring_index("b.reg", ".", -1))
    left, right = F.when(foreign, F.col("label")).otherwise(F.col("norm")), F.when(foreign, b_label).otherwise(b_norm)
    short = F.length("b.label") < 5
    glyph = (F.col("norm") == b_norm) | (foreign & (F.col("label") == b_label) & (F.col("seen") != F.col("b.label")))
    inside = ~short & F.replace("norm", F.lit("-"), F.lit("")).contains(F.col("b.label")) & ~F.col("own").contains(F.col("b.reg")) & F.col("norm").contains(F.col("b.label")) & ~F.col("own").endswith(F.col("b.reg"))
    vendor = F.substring_index("own", ".", 1).isin(*VENDOR_NAMES) | F.col("own").isin(*VENDOR_ZONES) | (F.substring_index("own", ".", 1) == F.col("b.label"))
    distance = F.levenshtein(left, right, max_distance)
    near = F.when(short, (distance == 1) & (F.length(left) == F.length(right)) & (F.length(left) >= 4)).otherwise((distance >= 1) & (F.abs(F.length(left) - F.length(right)) <= max_distance))
    known = ((left == "mail") & (right == "gmail")) | ((F.col("own") == "mail.com") & (F.col("b.reg") == "gmail.com"))
    kind = F.when(glyph, "homoglyph").when(inside, F.when(~vendor, "brand_spoof")).when(near & ~known, "levenshtein")
    hits = pairs.select("host", F.col("b.brand").alias("brand"), kind.alias("kind"), F.when(kind == "levenshtein", distance).alias("distance")).where("kind is not null")
    return hits.unionByName(idn)


def _plain_words(c: Column) -> Column:
    """Words (letters, digits, hyphens) with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_-]+", " ")), F.lit(" "))


def display_spoofs(df: DataFrame, row_id: str, from_header: str, names: list[tuple[str, list[str]]]) -> DataFrame:
    """(row_id, brand, label) where the display name holds a brand's name as a word and the
    address isn't the brand's; the first name of the list wins. A name followed by a product's
    word, or that follows another brand's name, is no spoof. Null headers give no row.
    """
    display, host = tx.sender_display(F.col(from_header)), F.substring_index(tx.sender_address(F.col(from_header)), "@", -1)
    rows = df.select(F.col(row_id), display.alias("d"), host.alias("h")).where("d <> '' and h <> ''").withColumn("d", _plain_words(F.col("d")))
    listed = F.array(*[F.struct(F.lit(label).alias("label"), _plain_words(F.lit(label)).alias("words"), F.lit(owners[0]).alias("brand"), F.array(*map(F.lit, owners)).alias("owners")) for label, owners in names])

    def spoofed(n: Column) -> Column:
        own = F.exists(n["owners"], lambda o: (F.col("h") == o) | F.endswith(F.col("h"), F.concat(F.lit("."), o)))
        rest = F.substring(F.col("d"), F.position(n["words"], F.col("d")) + F.length(n["words"]), F.length("d"))
        follows = F.exists(listed, lambda m: (m["label"] != n["label"]) & F.contains(F.col("d"), F.concat(m["words"], F.ltrim(n["words"]))))
        return F.contains(F.col("d"), n["words"]) & ~own & ~F.substring_index(rest, " ", 1).isin(*PRODUCT_WORDS) & ~follows

    hit = F.get(F.filter(listed, spoofed), F.lit(0))
    return rows.withColumn("hit", hit).where("hit is not null").select(row_id, "hit.brand", "hit.label")


def names_of(domains: list[str]) -> list[tuple[str, list[str]]]:
    """Names under which an organisation's own domains appear: their labels of four letters or more, and the domains."""
    out: dict[str, list[str]] = {}
    for d in domains:
        label = d.split(".")[-2] if "." in d else d
        if len(label) >= 4:
            out.setdefault(label, [d])
        out.setdefault(d, [d])
    return list(out.items())
