"""Text functions as Columns; they run in the JVM. Java's `\\w` and `\\s` are ASCII unless (?U) is set."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of page furniture that are dropped when markdown is cleaned, by the exact line or a part of it.
FOOTER_LINES = ["gizlilik politikası", "kvkk", "kullanım koşulları", "çerez politikası", "privacy policy", "terms", "terms and conditions", "cookie", "cookies", "iletişim", "iletişim bilgilerimiz", "contact"]
FOOTER_LINES_ASCII = ["gizlilik politikasi", "kvkk", "kullanim kosullari", "cerez politikasi", "privacy policy", "terms", "terms and conditions", "cookie", "cookies", "contact"]
FOOTER_STARTS = ["tel:", "telefon:", "phone:", "mailto:", "eposta:", "e-posta:"]
FOOTER_PARTS = [r"mah\.", "mahalle", "sokak", r"cad\.", "no:", "pk:", r"kat\b", r"daire\b", "istanbul", "ankara", "izmir"]

# What counts as yes or no, as a broken text, as a currency, as a policy.
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "off"]
PLACEHOLDERS = ["", "[object object]", "object-object"]
POLICY_WORDS = ["iade", "değişim", "degisim", "kargo", "teslimat", "garanti", "gizlilik", "kvkk", "şartlar", "sartlar", "koşullar", "kosullar", "sözleşme", "sozlesme", "iptal", "ödeme", "odeme", "mesafeli"]
PRODUCT_CODE = r"\b([A-Z]{2,}[-_ ]?\d{2,}[A-Z0-9]{0,4})\b"
AMOUNT = r"\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?"
PRICE = rf"(?i)((?:₺|\$|€)\s?{AMOUNT}|\b{AMOUNT}\s?(?:TL|TRY|USD|EUR)\b)"
DISPLAY_KEYS = ["tr", "TR", "name", "text", "title", "label", "value", "displayName", "display", "slug", "en", "EN"]

MAX_CHARS = 300_000
#: A heading of markdown, and its text.
HEADING = r"(?m)^#{1,6}\s+(.*\S)\s*$"


#: The characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends: looks at the ends alone."""
    return F.btrim(c, F.lit(WHITE))


def line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, no white space at the ends; null is empty."""
    return strip(line_ends(F.coalesce(c, F.lit(""))))


def cleanup_lines(c: Column) -> Column:
    """Lines without white space at their ends, without blank ones."""
    return F.array_join(F.filter(F.transform(F.split(line_ends(c), "\n"), strip), lambda x: x != ""), "\n")


def token_estimate(c: Column) -> Column:
    """The number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def cap_text(c: Column, most: int = MAX_CHARS) -> tuple[Column, Column, Column]:
    """The text cut to `most` characters, whether it was cut, and its length before."""
    return F.substring(c, 1, most), F.length(c) > most, F.length(c)


def title_norm(c: Column) -> Column:
    """Lower case, with runs of anything but word characters as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "ß", "ss"), r"(?U)[^\w]+", " "))


def display_text(c: Column) -> Column:
    """A scalar as text; empty for null, blank and broken ones."""
    t = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(PLACEHOLDERS), "").otherwise(t)


def display_json(c: Column) -> Column:
    """The text to show for a JSON object: the first preferred key that has one."""
    found = [F.nullif(display_text(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in DISPLAY_KEYS]
    nested = [F.nullif(display_text(F.get_json_object(c, f"$.{o}.{k}")), F.lit("")) for o in ("metadata", "translation", "translations", "item") for k in DISPLAY_KEYS]
    return F.when(c.startswith("{"), F.coalesce(*found, *nested, F.lit(""))).otherwise(display_text(c))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(display_text(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"-+", "-"), r"^-+|-+$", "")


def safe_doc_id(c: Column, prefix: str) -> Column:
    """A prefix and the slug of an id or url; null where that is blank (callers then make an id up)."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", F.concat(F.lit(f"{prefix}-"), s))


def short_text(c: Column, width: int) -> Column:
    """White space as one space, cut to `width` with an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) > width, F.concat(F.rtrim(F.substring(s, 1, width - 3)), F.lit("..."))).otherwise(s)


def has_heading(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?m)^#{1,6}\s+\S"), F.lit(False))


def product_codes(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PRODUCT_CODE), F.lit(1))


def prices(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PRICE), F.lit(1)), strip)


def headings(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HEADING), F.lit(1)), strip)


def is_policy_heading(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(POLICY_WORDS))


def content_type(text: Column, source: Column, doc_type: Column) -> Column:
    s, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (source, doc_type))
    return F.when(s.contains("upload") | d.contains("upload") | s.contains("library"), "upload").when(has_heading(text), "clean_markdown").otherwise("schema")


def coerce_bool(c: Column, default: bool) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False).otherwise(F.lit(default))


def parse_int(c: Column, default: int, minimum: int | None = None) -> Column:
    n = F.coalesce(c.try_cast("int"), F.lit(default))
    return F.greatest(n, F.lit(minimum)) if minimum is not None else n


def iso_timestamp(c: Column) -> Column:
    """An ISO date or time, Z allowed; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def is_object_id(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{24}$"), F.lit(False))


def storage_preferences(c: Column) -> Column:
    """The known stores of a comma list, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x.isin("db", "s3", "disk")))


def string_id(c: Column) -> Column:
    """A text id as a number from 2^62 up: the low 62 bits of the first 8 bytes of its SHA-1."""
    high = F.conv(F.substring(F.sha1(c.cast("binary")), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.sha1(c.cast("binary")), 9, 8), 16, 10).cast("long")
    return F.lit(1 << 62).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit((1 << 30) - 1)), 32)).bitwiseOR(low)


def resolve_id(c: Column) -> Column:
    """Digits are the id itself, other text is hashed, blank is null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")).when(t != "", string_id(t))


def sanitize_company(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", "")


def company_path(base: str, c: Column) -> Column:
    """The partition of a company under `base`; the global one where the id is blank."""
    s = sanitize_company(c)
    return F.when(s != "", F.concat(F.lit(f"{base}/company_id="), s)).otherwise(F.lit(f"{base}/company_id=__HIVE_DEFAULT_PARTITION__"))


def once(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often `use` names it, also within lambdas."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def distinct_lines(lines: Column) -> Column:
    """The first of lines that differ in case alone, in order, by two sorts."""
    keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"), x.alias("line"))))
    first = once(keyed, lambda ks: F.filter(ks, lambda k, i: (i == 0) | (F.get(ks, i - 1)["key"] != k["key"])))
    back = F.array_sort(F.transform(first, lambda k: F.struct(k["i"].alias("i"), k["line"].alias("line"))))
    return F.transform(back, lambda k: k["line"])


#: A markdown link: its text, and its target without white space around it.
LINK = r"\[([^\]]*)\]\(\s*((?i:javascript:void\(0\))|<[^>]*>|[^)]*?)\s*\)"
#: Targets that lead nowhere: the text of such a link stays where it is.
NOWHERE = ["", "#", "javascript:void(0)"]
#: An address in running text, also with one slash where there should be two.
ADDRESS = r"(?i)\bhttps?:(?://\S+|/[^/\s]\S*)"


def _link_shown(piece: Column, own_line: bool) -> Column:
    """What a piece that link_pieces() yields leaves of itself: links that lead somewhere their text, on a line of its own; others their text; the rest itself."""
    text, target = strip(F.regexp_extract(piece, LINK, 1)), F.lower(F.regexp_extract(piece, LINK, 2))
    leads = F.when(text == "", "").otherwise(F.concat(F.lit("\n"), text, F.lit("\n")) if own_line else text)
    return F.when(~piece.rlike(f"^(?:{LINK})$"), piece).when(target.isin(NOWHERE), text).otherwise(leads)


def link_pieces(c: Column) -> Column:
    """The text cut into markdown links and what lies between them, in order."""
    return F.regexp_extract_all(c, F.lit(rf"{LINK}|[^\[]+|\["), F.lit(0))


def clean_markdown(c: Column, ascii_footers: bool = False, one_per_line: bool = True, drop_footers: bool = True, compat: bool = False) -> Column:
    """Markdown as plain lines: links as their text, no bare URLs, no footnote marks at the start of a line, no page furniture, and each line once
    whatever its case. A picture is a link after an exclamation mark: its text stays.

    `compat` also drops every line that begins with c, as the ASCII list once did by an unescaped bracket.
    """
    unmarked = F.regexp_replace(normalize_text(c), r"(?m)^\s*\[[0-9]+\]", "")
    shown = F.array_join(F.transform(link_pieces(unmarked), lambda p: _link_shown(p, one_per_line)), "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(shown, ADDRESS, ""), "\n"), strip), lambda x: x != "")
    if drop_footers:
        whole = FOOTER_LINES_ASCII if ascii_footers else FOOTER_LINES
        starts = [] if ascii_footers else FOOTER_STARTS
        furniture = "|".join([rf"^(?:{'|'.join(map(re.escape, whole))})$", *(f"^{re.escape(s)}" for s in starts), f"(?:{'|'.join(FOOTER_PARTS)})", "^copyright", "^c" if compat and ascii_footers else r"^\(c\)" if ascii_footers else "^©"])
        lines = F.filter(lines, lambda x: (F.length(x) > 2) & ~x.rlike(f"(?iu){furniture}"))
    return F.array_join(distinct_lines(lines), "\n")
