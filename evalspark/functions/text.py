"""Text expressions: stripping, slugs, identifiers and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import REJECT_CODES

# Endings that a slug leaves out.
MODEL_ENDINGS = ("safetensors", "ckpt", "pt", "pth", "bin", "gguf")
SAFE_FILE = r"^[^/\\\x00]+$"


def fixed(x: Column, digits: int) -> Column:
    """A number with that many decimals, rounded half to even on its exact binary value, as Python writes it."""
    text = F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))
    return F.when(F.isnan(x), F.lit("nan")).otherwise(text)


def python_float(x: Column) -> Column:
    """A double as Python's ``str`` writes it: exponents only below 1e-4 and from 1e16 on."""
    plain = x.cast("string")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(plain, r"E.*$|[-.]", ""), "0+$", ""), F.lit("")), F.lit("0"))
    whole = F.when(F.length(digits) <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(power)))
    written = F.when(power == -4, F.concat(F.lit("0.000"), digits)).when(power.between(7, 15), whole).otherwise(scientific)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(power.isNull(), plain).otherwise(F.concat(sign, written)))


def quoted(x: Column) -> Column:
    """A string as Python's ``repr`` writes one without control characters."""
    bare = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(bare, F.lit("'"), F.lit("\\'")), F.lit("'")))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def not_blank(x: Column) -> Column:
    return F.coalesce(strip(x) != "", F.lit(False))


def slug(x: Column) -> Column:
    """Lower case, one known ending off, other runs to '-', none at the ends; 'x' if nothing is left."""
    bare = F.regexp_replace(F.lower(x), rf"\.({'|'.join(MODEL_ENDINGS)})$", "")
    joined = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("x"))


def category_slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", "_"), "-", "_")


def run_id(prefix: Column, lora: Column, weight: Column, item: Column, kind: str = "p") -> Column:
    """``prefix-lNN-wNN-pNNN``: numbers have at least that many digits."""
    return F.format_string(f"%s-l%02d-w%02d-{kind}%03d", prefix, lora, weight, item)


def cell_id(prefix: Column, index: Column, base: Column, step: Column) -> Column:
    return F.format_string("%s-c%02d-%s-%s", prefix, index, slug(base), slug(step))


def is_file_name(x: Column) -> Column:
    """A plain name: not blank, not '.' or '..', no separator and no NUL."""
    return not_blank(x) & x.rlike(SAFE_FILE) & ~x.isin(".", "..")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def rating_of(tags: Column) -> Column:
    """The last tag ``rating:<int>`` with a value of 1 to 5."""
    values = F.transform(F.filter(tags, lambda t: t.startswith("rating:")), lambda t: F.substring(t, F.lit(8), F.length(t)).try_cast("int"))
    held = F.filter(values, lambda v: v.between(1, 5))
    return F.when(F.size(held) > 0, F.element_at(held, -1))


def rejects_of(tags: Column) -> Column:
    """Known codes of ``reject:<code>`` tags, each once, in order."""
    codes = F.transform(F.filter(tags, lambda t: t.startswith("reject:")), lambda t: F.substring(t, F.lit(8), F.length(t)))
    return F.array_distinct(F.filter(codes, lambda c: c.isin(*REJECT_CODES)))


def lora_key(loras: Column) -> Column:
    """Names joined by '+', null without any."""
    return F.nullif(F.array_join(F.transform(loras, lambda x: x["name"]), "+"), F.lit(""))


def prompt_with_loras(prompt: Column, loras: Column) -> Column:
    """Tags as the web interface takes them: a name keeps its folders and loses its ending."""
    tags = F.transform(loras, lambda x: F.concat(F.lit("<lora:"), F.regexp_replace(x["name"], r"(?<=[^/])\.[^./]*$", ""), F.lit(":"), python_float(x["weight"].cast("double")), F.lit(">")))
    return F.when(F.size(loras) > 0, F.concat(prompt, F.lit(" "), F.array_join(tags, " "))).otherwise(prompt)


def label_of(labels: Column, key: str) -> Column:
    """A value of a JSON object text."""
    return F.from_json(labels, "map<string,string>")[key]


def labels_json(labels: Column) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))
