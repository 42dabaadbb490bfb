"""Cleaning and parsing of texts as column expressions; no shuffle, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathmill.functions.tokens import strip

DOTS = "ㆍ・‧·"


def clean_bullets(text: Column) -> Column:
    """Bullets and numbers on lines of their own, bullets as dashes, at most one empty line, no outer white space."""
    x = F.regexp_replace(text, "ㆍ", "•")
    x = F.regexp_replace(x, r"(?<!\n)•", "\n•")
    x = F.regexp_replace(x, r"(?m)^•\s*", "- ")
    x = F.regexp_replace(x, r"(?<!\n)(\d+\. )", "\n$1")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def blank_to_null(value: Column) -> Column:
    return F.when(strip(value) != "", value)


#: Letters and digits of any script with the underscore, any white space, and the endings of bare domains.
WORD_CHARS = r"\p{L}\p{N}_"
NOT_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"
DOMAIN_ENDS = ["net", "com", "org", "io", "kr"]


def without_contacts(text: Column, domains: bool = True) -> Column:
    """Mail addresses, then web addresses, then bare lower-case domains become a blank each.

    A mail address is a run of word characters, dots, plus and minus signs, an @, and a run of word characters, dots and
    minus signs. A web address goes from its scheme to the next white space. A domain is one label of lower-case letters,
    digits and minus signs that no letter or digit stands before, a dot, and a listed ending that ends a word: of
    `www.naver.com` the first label stays, and so does the full stop after a sentence's last word.
    """
    x = F.regexp_replace(text, f"[{WORD_CHARS}.+-]+@[{WORD_CHARS}.-]+", " ")
    x = F.regexp_replace(x, f"https?://{NOT_BLANK}+", " ")
    ending = "|".join(DOMAIN_ENDS)
    return F.regexp_replace(x, rf"(?<![A-Za-z0-9])[a-z0-9][a-z0-9-]*\.(?:{ending})(?![{WORD_CHARS}])", " ") if domains else x


def without_parentheses(text: Column) -> Column:
    """Without what stands in parentheses of either width; one that is not closed stays."""
    parts = F.split(F.translate(text, "（）", "()"), r"\(", -1)
    closed = lambda p: F.when(F.contains(p, F.lit(")")), F.substring(p, F.instr(p, ")") + 1, F.length(p))).otherwise(F.concat(F.lit("("), p))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(closed(p))), "")


def listed_by_commas(text: Column) -> Column:
    """Commas, slashes and the words for or / and become plain commas."""
    x = F.translate(text, "，/", ",,")
    for word in ("또는", "및"):  # fixed values
        x = F.replace(x, F.lit(word), F.lit(","))
    return x


def fold_dots(name: Column, to: str = "·") -> Column:
    return strip(F.translate(name, DOTS, to * len(DOTS)))


def name_key(name: Column) -> Column:
    """Without parentheses of either width and white space, in lower case."""
    return F.lower(F.regexp_replace(name, r"[()（）\s]", ""))


def safe_name(name: Column) -> Column:
    return F.translate(strip(name), '/\\:*?"<>| ', "_" * 10)


def document_name(prefix: str, *parts: Column) -> Column:
    return F.concat(F.concat_ws("_", F.lit(prefix), *[safe_name(p) for p in parts]), F.lit(".txt"))


def lines_of(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _position(lines: Column, test) -> Column:
    """1-based place of the first line that passes, or null."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull()))


def clean_page(text: Column, name: Column, footers: list[str], starter: str, noise: list[str], drop: str) -> Column:
    """Lines of a scraped page: cut at the first footer, from after the last starter line on, without bullets, noise,
    the page's own name and lines that the `drop` pattern matches."""
    lines = lines_of(text)
    footer = _position(lines, lambda x: F.exists(F.array(*map(F.lit, footers)), lambda f: F.contains(x, f)))
    cut = F.when(footer.isNull(), lines).otherwise(F.slice(lines, 1, footer - 1))
    start = F.array_max(F.filter(F.transform(cut, lambda x, i: F.when(x == starter, i + 1)), lambda i: i.isNotNull()))
    body = F.slice(cut, F.coalesce(start, F.lit(0)) + 1, F.size(cut))
    plain = F.transform(body, lambda x: strip(F.regexp_replace(x, r"^[•\-*▶■○·]+\s*", "")))
    return F.filter(plain, lambda x: (x != "") & (x != name) & ~x.isin(noise) & ~x.rlike(drop))


def skip_reason(college: Column, text: Column, lines: Column, excluded: list[str], markers: list[str], least: int = 3) -> Column:
    """Why a page is not used, or null."""
    listed = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))
    return F.when(college.isin(excluded), "excluded").when(listed, "directory").when(F.size(lines) < least, "short")


#: The format of a course, a dash and tag, name, code and credits, with any white space between them.
COURSE_FORMAT = r"(?U)-\s*\[([^\]]+)\]\s*(.+?)\s*\(\s*([A-Za-z0-9]+)\s*,\s*(\d+)\s*학점\s*\)"
WIDE_DIGITS = "０１２３４５６７８９"


def parse_course_line(line: Column, types: dict[str, str]) -> Column:
    """Struct of the first "- [tag] name (code, n학점)" in a line, whatever stands before and after it.

    Null where there is none, or where its tag is not listed; a later one in the line is not looked for then.
    """
    tag, name, code, digits = (strip(F.regexp_extract(line, COURSE_FORMAT, k)) for k in range(1, 5))
    credits = F.translate(digits, WIDE_DIGITS, "0123456789").try_cast("int")
    kind = F.try_element_at(F.create_map(*[F.lit(v) for kv in types.items() for v in kv]), tag)
    return F.when(credits.isNotNull() & kind.isNotNull(), F.struct(tag.alias("tag"), name.alias("name"), code.alias("code"), credits.alias("credits"), kind.alias("course_type")))


def html_text(html: Column) -> Column:
    """Tags become line ends; three and more line ends become two; outer white space goes."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", "\n"), r"\n{3,}", "\n\n"))


def html_sections(html: Column, headings: dict[str, list[str]]) -> Column:
    """Map from section to the text between its first heading and the next section's first heading."""
    found = []
    for key, words in headings.items():
        each = [F.struct(F.instr(html, F.lit(w)).alias("at"), F.lit(order).alias("order"), F.lit(key).alias("key"), F.lit(len(w)).alias("n")) for order, w in enumerate(words)]
        found.append(F.array_min(F.filter(F.array(*each), lambda x: x["at"] > 0)))
    starts = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    ends = F.concat(F.slice(F.transform(starts, lambda x: x["at"]), 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.length(html) + 1))
    body = F.zip_with(starts, ends, lambda s, e: F.struct(s["key"].alias("key"), html_text(F.substring(html, s["at"] + s["n"], e - s["at"] - s["n"])).alias("text")))
    return F.map_from_entries(F.filter(body, lambda x: x["text"] != ""))


def first_area(html: Column, areas: list[str]) -> Column:
    """Text of the first area pattern (one group) that matches with content, else of the whole page."""
    each = [F.nullif(html_text(F.regexp_extract(html, p, 1)), F.lit("")) for p in areas]
    return F.coalesce(*each, html_text(html))


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def source_id(url: Column, pattern: str = r"/wd/(\d+)") -> Column:
    """The pattern's group, else the last part of the path."""
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.substring_index(canonical_url(url), "/", -1))


def labelled(text: Column, label: str) -> Column:
    """Value of the first line "label: value", or null."""
    return F.nullif(strip(F.regexp_extract(text, rf"(?m)^{label}:[ \t]*(.*)$", 1)), F.lit(""))


def document_metadata(name: Column, text: Column, kinds: dict[str, dict[str, str]]) -> Column:
    """Map of the fields that the document's kind, told by its name's prefix, has."""
    out = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for prefix, fields in kinds.items():
        pairs = [v for field, label in fields.items() for v in (F.lit(field), labelled(text, label))]
        out = out.when(F.startswith(name, F.lit(prefix)), F.map_filter(F.create_map(F.lit("doc_type"), F.lit(prefix), *pairs), lambda _, v: v.isNotNull()))
    return out


def file_code(name: Column) -> Column:
    """The seven characters after eleven digits, or null."""
    return F.nullif(F.regexp_extract(name, r"_\d{11}([A-Z0-9]{7})", 1), F.lit(""))


def normalise_requirement(raw: Column, nothing: list[str], starts: list[str], longest: int = 60) -> Column:
    """Null for values that say nothing: listed, with a listed start, or free text; else the value without parentheses."""
    plain = F.rtrim(strip(without_parentheses(raw)), F.lit("."))
    tight = F.lower(F.replace(plain, F.lit(" "), F.lit("")))
    says_nothing = tight.isin(nothing) | (plain == "")
    for s in starts:
        says_nothing = says_nothing | F.startswith(tight, F.lit(s))
    is_list = F.contains(listed_by_commas(plain), F.lit(",")) | F.contains(plain, F.lit(":"))
    return F.when(~says_nothing & (is_list | (F.length(plain) <= longest)), plain)


def split_requirement(raw: Column) -> Column:
    """Names after the last colon, without parentheses, split at separators and words for or / and."""
    names = F.split(listed_by_commas(without_parentheses(F.substring_index(raw, ":", -1))), ",")
    return F.filter(F.transform(names, lambda name: F.btrim(strip(name), F.lit("."))), lambda name: name != "")


def embedding_document(lines: Column, menus: list[str], phrases: list[str]) -> Column:
    """Lines without menu lines, marketing phrases and lines of one character, joined."""
    pattern = "|".join(sorted((escaped(p) for p in phrases), key=len, reverse=True)) or "(?!)"
    cleaned = F.transform(F.filter(lines, lambda x: ~x.isin(menus)), lambda x: strip(F.regexp_replace(x, pattern, "")))
    return F.array_join(F.filter(cleaned, lambda x: F.length(x) >= 2), "\n")


def escaped(text: str) -> str:
    """The text as a regular expression that matches it alone."""
    return "".join(f"\\{c}" if c in r".^$*+?{}[]\|()" else c for c in text)


def assembled(header: Column, fields: dict[str, Column], sections: dict[str, Column]) -> Column:
    """A header line, "label: value" lines and "[section]" blocks; empty parts are left out."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]
    blocks = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"\n[{k}]\n"), v)) for k, v in sections.items()]
    return F.concat_ws("\n", header, *lines, *blocks)


def profile_text(fields: dict[str, Column], templates: dict[str, str], expand: dict[str, Column] | None = None, separator: str = ", ") -> Column:
    """Clauses in declared order, a field's values joined; empty fields are left out; listed fields go through a map."""
    clauses = []
    for name, template in templates.items():
        values = fields[name]
        if expand and name in expand:
            known = expand[name]
            values = F.transform(values, lambda v: F.coalesce(F.try_element_at(known, v), v))  # noqa: B023
        before, _, after = template.partition("{value}")
        clauses.append(F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(before), F.array_join(values, ", "), F.lit(after))))
    return F.concat_ws(separator, *clauses)


def estimated_semester(semester: Column, admission: Column, year: int) -> Column:
    return F.coalesce(semester, F.least(F.lit(8), F.greatest(F.lit(1), (F.lit(year) - admission) * 2 + 1)))


def profile_errors(fields: dict[str, Column], work_values: list[str], company_types: list[str]) -> Column:
    """Names of the rules that an input breaks; an empty array for a valid one."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    inside = lambda c, allowed: F.forall(c, lambda v: v.isin(allowed))
    rules = {
        "admission_year": fields["admission_year"].between(2000, 2030),
        "college": F.length(fields["college"]) >= 1,
        "department": F.length(fields["department"]) >= 1,
        "current_tracks": size(fields["current_tracks"]).isin(0, 2),
        "current_semester": fields["current_semester"].isNull() | fields["current_semester"].between(1, 8),
        "interests": size(fields["interests"]).between(1, 5),
        "dev_interests": size(fields["dev_interests"]).between(1, 3),
        "work_values": size(fields["work_values"]).between(0, 3) & inside(fields["work_values"], work_values),
        "company_types": (size(fields["company_types"]) >= 1) & inside(fields["company_types"], company_types),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def excluded_name(name: Column, identifier: Column, prefixes: list[str], blacklist: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(name, p)) | identifier.isin(blacklist)


def json_tags(text: Column) -> Column:
    """Tags of a JSON list of strings; anything else gives none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clamped_score(raw: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(raw.try_cast("double"), F.lit(0.0)))), F.lit(0.0))


def truncated(text: Column, n: int = 10_000) -> Column:
    return F.substring(text, 1, n)


def without_evidence(text: Column, mark: str = "근거") -> Column:
    """Without a last line "[mark: ...]"."""
    return F.regexp_replace(text, rf"\n*[ \t]*\[{mark}:[^\]]*\][ \t]*$", "")


def focus_sections(text: Column, wanted: list[str], stops: list[str], n: int = 5000) -> Column:
    """Lines of the wanted "[section]" blocks, cut at the first stop mark and to n characters."""
    at = F.array_min(F.filter(F.array(*[F.instr(text, F.lit(s)) for s in stops]), lambda i: i > 0))
    body = F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))
    blocks = F.split(body, r"\n(?=\[)")
    return F.substring(F.array_join(F.filter(blocks, lambda b: F.regexp_extract(b, r"^\[([^\]]*)\]", 1).isin(wanted)), "\n"), 1, n)


def packed_blocks(blocks: Column, limit: int) -> Column:
    """Blocks in order while their length in all stays within the limit; a block that is too long is passed over."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda s, b: s["used"] + F.length(b) <= limit
    step = lambda s, b: F.when(fits(s, b), F.struct((s["used"] + F.length(b)).alias("used"), F.concat(s["kept"], F.array(b)).alias("kept"))).otherwise(s)
    return F.aggregate(blocks, start, step)["kept"]


def field_or_null_mark(text: Column, label: str) -> tuple[Column, Column]:
    """The field's value, or the text "null" where its line is absent, and whether it was absent."""
    value = labelled(text, label)
    return F.coalesce(value, F.lit("null")), ~text.rlike(rf"(?m)^{label}:")
