"""Text functions as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> media type, for paths whose type is not given.
MEDIA_TYPES = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".txt": "text/plain", ".csv": "text/csv", ".json": "application/json", ".xml": "application/xml", ".html": "text/html", ".htm": "text/html", ".md": "text/markdown", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
#: Words left out when stop words are removed.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def media_type(path: Column) -> Column:
    """By the path's extension; ``application/octet-stream`` for any other."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for ext, kind in MEDIA_TYPES.items():
        out = F.when(extension == ext, kind).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Tags to a space, white space collapsed."""
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def html_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def strip_markdown(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"[#*`\[\]()_~]", ""))


def normalize(text: Column, case_sensitive: bool = False, stop_words: bool = False) -> Column:
    """Lower case, white space collapsed, all but ASCII letters, digits and spaces removed."""
    low = text if case_sensitive else F.lower(text)
    plain = F.regexp_replace(squeeze(low), r"[^a-zA-Z0-9\s]", "")
    if not stop_words:
        return plain
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin(*STOP_WORDS)), " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), r"\s+"), lambda w: w != "")


def statistics(text: Column) -> dict[str, Column]:
    """Characters, words, lines, non-blank lines, words a line, minutes at 200 words a minute."""
    chars = F.length(text)
    n_words = F.regexp_count(text, F.lit(r"\S+"))
    lines = chars - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return {"char_count": chars, "word_count": n_words, "line_count": lines, "filled_lines": filled, "words_per_line": n_words / F.greatest(filled, F.lit(1)), "reading_minutes": n_words / 200.0}


def graph_label(name: Column) -> Column:
    """A name fit for a label: other characters to underscores, no leading digit, none doubled or trailing."""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)
    clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "Unknown").otherwise(clean)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("||", *parts))


def pair_key(a: Column, b: Column, method: str) -> Column:
    """The same for either order."""
    return F.md5(F.concat_ws("||", F.least(a, b), F.greatest(a, b), F.lit(method)))


def secret_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def escape_html(text: Column) -> Column:
    """``&`` stays as it is."""
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def json_in(answer: Column) -> Column:
    """The answer if it is JSON, else the first brace to the last if that is, else an empty object."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(answer).isNotNull(), answer).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner).otherwise("{}")


VALIDATORS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "url": r"^https?://[^\s/$.?#][^\s]*$",
    "entity_type": r"^[A-Za-z][A-Za-z0-9_]{0,49}$",
}


def valid(kind: str, value: Column) -> Column:
    return F.coalesce(value.rlike(VALIDATORS[kind]), F.lit(False))


def valid_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    number = value.try_cast("double")
    inside = number.isNotNull()
    if low is not None:
        inside = inside & (number >= low)
    if high is not None:
        inside = inside & (number <= high)
    return F.coalesce(inside, F.lit(False))


def valid_json(value: Column) -> Column:
    return F.try_parse_json(value).isNotNull()


def connection_url(kind: Column, user: Column, password: Column, host: Column, port: Column, database: Column) -> Column:
    """Connection string by kind of database."""
    scheme = F.when(kind == "postgresql", "postgresql").when(kind == "mysql", "mysql+pymysql").when(kind == "mssql", "mssql+pyodbc").otherwise(kind)
    default = F.when(kind == "postgresql", "5432").when(kind == "mysql", "3306").when(kind == "mssql", "1433")
    return F.concat(scheme, F.lit("://"), user, F.lit(":"), password, F.lit("@"), host, F.coalesce(F.concat(F.lit(":"), F.coalesce(port, default)), F.lit("")), F.lit("/"), database)


def at_path(record: Column, path: str) -> Column:
    """The value at a dotted path of a JSON record, null where it leads nowhere."""
    return F.get_json_object(record, "$." + path)


def suggestion(answer: Column) -> Column:
    """(method, confidence, reasoning) of a model's answer: its first JSON object, else ``key: value`` lines, else
    manual at 0.5."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*?\})", 1)
    parsed = F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)

    def told(name: str, pattern: str) -> Column:
        line = F.nullif(F.regexp_extract(answer, rf"(?im)\b{name}\b\W*[:=]\W*({pattern})", 1), F.lit(""))
        return F.coalesce(F.get_json_object(parsed, f"$.{name}"), line)

    return F.struct(F.coalesce(told("method", r"\w+"), F.lit("manual")).alias("method"), F.coalesce(told("confidence", r"[0-9.]+").try_cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(told("reasoning", r"[^\n]+"), F.lit("")).alias("reasoning"))


def uptime(seconds: Column) -> Column:
    """``3d 4h 5m``, without the days or hours that are none."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(days, "d"), part(hours, "h"), F.concat(minutes.cast("string"), F.lit("m")))


def short_date(at: Column) -> Column:
    return F.date_format(at, "dd/MM/yyyy HH:mm")


def sealed(text: Column, key: str) -> Column:
    """Encrypted by AES-GCM under a key of 16, 24 or 32 bytes, in base64; the same text never comes out twice."""
    return F.base64(F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM")))


def opened(sealed_text: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(sealed_text), F.lit(key), F.lit("GCM")).cast("string")
