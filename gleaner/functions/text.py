"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed

#: White space at either end, newlines included.
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
GAP = r"[\x20\x09-\x0D]+"


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, ENDS, "")


def words(x: Column) -> Column:
    return F.array_remove(F.split(x, GAP), "")


def collapse(x: Column) -> Column:
    return F.array_join(words(x), " ")


def lines(x: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    split = lambda v: F.split(F.regexp_replace(F.replace(v, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n")
    return let(x, lambda v: F.when(v == "", F.array().cast("array<string>")).otherwise(split(v)))


def first_line(x: Column) -> Column:
    return F.get(lines(x), 0)


def has_any(x: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(p) for p in parts])


def truncate(x: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def content_hash(x: Column) -> Column:
    return F.sha2(trim_all(x).cast("binary"), 256)


def typed_hash(kind: Column, content: Column, directory: Column) -> Column:
    """Commands by command and directory, screenshots not at all, other text by content."""
    return F.when(kind == "command", content_hash(F.concat(content, F.lit(":"), directory))).when(kind == "screenshot", F.lit(None)).otherwise(content_hash(content))


def initial_summary(x: Column) -> Column:
    flat = F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.substring(flat, 1, 50)


def clean_text(x: Column) -> Column:
    """Without markdown marks, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(x, r"[\n\r]", " "), r"\*+|_+|~~|`|#", ""))


def error_summary(x: Column) -> Column:
    line = first_line(x)
    after = F.regexp_extract(line, r"(?s)ERROR (.*)$", 1)
    module = F.regexp_extract(after, r"^([^\]]*)\]", 1)
    parts = F.split(after, ":")
    message = F.coalesce(F.get(parts, 1), F.get(F.split(after, "]"), 1), after)
    error = F.when(module.contains("::"), F.concat(F.lit("Error in "), F.get(F.split(module, "::"), 0))).otherwise(truncate(F.concat(F.lit("Error: "), trim_all(message)), 50))
    warning = truncate(F.concat(F.lit("Warning: "), trim_all(F.regexp_extract(line, r"(?s)WARN(.*)$", 1))), 50)
    return F.when(line.contains("ERROR "), error).when(line.contains("WARN"), warning)


def command_summary(x: Column) -> Column:
    command = trim_all(F.regexp_replace(F.regexp_replace(trim_all(first_line(x)), r"^\$+", ""), r"^>+", ""))
    word = F.get(words(command), 0)
    known = word.isin(*fixed.SUMMARY_COMMANDS) | word.startswith("./") | word.startswith("/")
    return F.when(known, truncate(F.concat(F.lit("$ "), command), 50))


def code_summary(x: Column) -> Column:
    line = trim_all(first_line(x))
    second = F.get(words(line), 1)
    name = F.regexp_extract(line, r"([\p{L}\p{N}_][^( {]*)", 1)
    module = F.get(F.split(F.regexp_replace(second, ";+$", ""), "::"), 0)
    starts = line.startswith("import ") | line.startswith("from ") | line.startswith("use ")
    return (
        F.when(has_any(line, ("fn ", "function ", "def ")) & (name != ""), F.concat(F.lit("Function: "), name))
        .when(starts, F.concat(F.lit("Import: "), module))
        .when(has_any(line, ("class ", "struct ", "interface ")), F.concat(F.lit("Type: "), F.regexp_replace(second, r"[{:]+$", "")))
    )


def url_summary(x: Column) -> Column:
    line = trim_all(first_line(x))
    rest = F.regexp_extract(line, r"^[^:]*?://(.*)$", 1)
    domain, path = F.get(F.split(rest, "/"), 0), F.coalesce(F.get(F.split(rest, "/"), 1), F.lit(""))
    link = F.when(path == "", F.concat(F.lit("Link: "), domain)).otherwise(truncate(F.concat(F.lit("Link: "), domain, F.lit("/"), path), 50))
    return F.when(x.startswith("http://") | x.startswith("https://"), link)


def build_summary(x: Column) -> Column:
    compiling = F.size(F.filter(lines(x), lambda v: v.contains("Compiling")))
    finished = x.contains("Finished") & has_any(x, ("profile", "target"))
    tool = has_any(x, ("cargo", "npm", "yarn"))
    return (
        F.when(compiling > 0, F.concat(F.lit("Build: Compiling "), compiling.cast("string"), F.lit(" crates")))
        .when(finished & x.contains("unoptimized"), F.lit("Build: Finished (dev)"))
        .when(finished, F.lit("Build: Finished (release)"))
        .when(tool & x.contains("test"), F.lit("Build: Test output"))
        .when(tool & x.contains("build"), F.lit("Build: Build output"))
    )


def log_summary(x: Column) -> Column:
    count = lambda mark: F.regexp_count(x, F.lit(mark))
    first_error = F.get(F.filter(lines(x), lambda v: v.contains("❌")), 0)
    busy, done, warned = count("🔄"), count("✅"), count("⚠️")
    return (
        F.when(x.contains("❌"), truncate(F.concat(F.lit("Error: "), trim_all(first_error)), 45))
        .when(warned > 0, F.concat(F.lit("Warning messages ("), warned.cast("string"), F.lit(")")))
        .when((busy > 0) & x.contains("batch"), F.lit("Log: Batch processing"))
        .when((busy > 0) & x.contains("embedding"), F.lit("Log: Embedding jobs"))
        .when((done > 0) & x.contains("ENGINE"), F.lit("Log: Model loaded"))
        .when((done > 0) & x.contains("completed"), F.concat(F.lit("Log: "), done.cast("string"), F.lit(" tasks completed")))
    )


def note_summary(x: Column) -> Column:
    line = F.get(F.filter(lines(x), lambda v: trim_all(v) != ""), 0)
    return F.concat(F.lit("Note: "), truncate(clean_text(line), 45))


def rule_summary(content: Column, topic: Column | None = None) -> Column:
    """The first rule that gives a summary; topic is an optional expression for plain text, which may be a Python function."""
    x = trim_all(content)
    keys = F.when(x.contains("Accelerator") & x.contains("register"), F.lit("Keyboard shortcuts"))
    rules = let(x, lambda v: F.coalesce(error_summary(v), command_summary(v), code_summary(v), url_summary(v), build_summary(v), log_summary(v)))
    return F.when(x == "", F.lit("Empty snippet")).otherwise(F.coalesce(rules, keys, *([topic] if topic is not None else []), let(x, note_summary)))


def structure(x: Column) -> Column:
    """Terminal, Code, Table, List or Plain."""
    return let(lines(x), _structure_of)


def _structure_of(rows: Column) -> Column:
    n = F.size(rows)
    share = lambda k: k / n
    commands = F.size(F.filter(rows, lambda v: v.rlike(fixed.COMMAND_LINE_PATTERN)))
    keywords = F.size(F.filter(rows, lambda v: has_any(v, fixed.CODE_KEYWORDS)))
    symbols = F.size(F.filter(rows, lambda v: has_any(v, fixed.CODE_SYMBOLS)))
    tables = F.size(F.filter(rows, lambda v: F.length(v) - F.length(F.replace(v, F.lit("|"), F.lit(""))) >= 2))
    bullets = F.size(F.filter(rows, lambda v: v.rlike(r"^\s*[-*+]\s")))
    numbers = F.size(F.filter(rows, lambda v: v.rlike(r"^\s*\d+\.\s")))
    return (
        F.when(n == 0, "Plain")
        .when((commands >= 2) & (share(commands) >= 0.3), "Terminal")
        .when(((keywords >= 2) | (symbols >= 2)) & (share(keywords + symbols) >= 0.2), "Code")
        .when((tables >= 3) & (share(tables) >= 0.5), "Table")
        .when((bullets >= 3) | (numbers >= 3), "List")
        .otherwise("Plain")
    )


def content_type(kind: Column) -> Column:
    """Summary content type of a structure."""
    return F.when(kind.isin("Code", "Terminal"), kind).when(kind.isin("Table", "List"), F.lit("Document")).otherwise(F.lit("General"))


def caption_type(caption: Column) -> Column:
    x = F.lower(caption)
    found = F.lit("General")
    for name, keys in reversed(fixed.CAPTION_KEYWORDS):
        found = F.when(has_any(x, keys), name).otherwise(found)
    for name, keys in reversed(fixed.CAPTION_PREFIXES):
        found = F.when(reduce(lambda a, b: a | b, [x.startswith(k) for k in keys]), name).otherwise(found)
    return found


def tags(x: Column) -> Column:
    """Up to two tags, in the rules' order."""
    low = F.lower(x)
    python = low.contains("def ") | (low.contains("import ") & low.contains("python"))
    rules = [(python if tag == "python" else has_any(low, found), tag) for tag, found in fixed.TAG_WORDS]
    return F.slice(F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules))), 1, 2)


def command_family(x: Column) -> Column:
    """Struct of name and emoji of a command's tool family, or null."""
    tool = F.lower(F.get(F.split(F.get(words(first_line(x)), 0), "-"), 0))
    found = F.lit(None).cast("struct<name:string,emoji:string>")
    for tools, name, emoji in fixed.COMMAND_FAMILIES:
        found = F.when(tool.isin(*tools), F.struct(F.lit(name).alias("name"), F.lit(emoji).alias("emoji"))).otherwise(found)
    return found


def app_emoji(app: Column) -> Column:
    found = F.lit(fixed.OTHER_APP_EMOJI)
    for name, emoji in fixed.APP_EMOJI:
        found = F.when(F.trim(app) == name, emoji).otherwise(found)
    return found


def worth_saving(command: Column, min_length: int = fixed.COMMAND_MIN_LENGTH) -> Column:
    x = trim_all(command)
    parts = words(x)
    base = F.get(parts, 0)
    interesting = (F.length(x) > min_length) | has_any(x, ("|", "&&", ">", "--")) | x.startswith("sudo") | (F.size(parts) >= 3) | (x.contains("-") & (F.size(parts) >= 2))
    return F.when(x == "", False).when(base.isin(*fixed.COMMAND_BLOCKLIST), False).when(base.isin(*fixed.COMMAND_ALLOWLIST), True).otherwise(interesting)


def normalize_category(name: Column) -> Column:
    return collapse(F.translate(F.lower(name), "_-", "  "))


def without_emoji(name: Column) -> Column:
    blocks = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fixed.EMOJI_BLOCKS)
    return trim_all(F.regexp_replace(name, f"[{blocks}]", ""))


def similarity(left: Column, right: Column) -> Column:
    """1 if equal, the ratio of lengths if one holds the other, else the Jaccard of their characters; case is ignored."""
    a, b = F.lower(left), F.lower(right)
    inside = a.contains(b) | b.contains(a)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when(a == b, 1.0).when(inside, ratio).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def estimate_tokens(x: Column) -> Column:
    return F.floor(F.octet_length(x) / 4)


def cache_key(query: Column) -> Column:
    return collapse(F.lower(query))


def extract_all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def entities(x: Column) -> Column:
    """urls, emails, file_paths, code_snippets, commands."""
    paths = F.filter(extract_all(x, fixed.PATH_PATTERN), lambda v: F.length(v) > 3)
    commands = F.filter(lines(x), lambda v: v.rlike(fixed.COMMAND_LINE_PATTERN))
    code = F.array_sort(F.array_distinct(F.concat(extract_all(x, fixed.CODE_PATTERN), indented_blocks(x))))
    return F.struct(extract_all(x, fixed.URL_PATTERN).alias("urls"), extract_all(x, fixed.EMAIL_PATTERN).alias("emails"), paths.alias("file_paths"), code.alias("code_snippets"), commands.alias("commands"))


def indented_blocks(x: Column) -> Column:
    """Runs of lines that begin with four blanks or a tab, over ten characters, that another line follows."""
    found = F.regexp_extract_all(x, F.lit(r"(?m)((?:^(?:    |\t).*\n)+)(?=.*)"), F.lit(1))
    return F.filter(F.transform(found, trim_all), lambda v: F.length(v) > 10)


def image_file(path: Column) -> Column:
    return path.rlike(r"(?i)\.(png|jpe?g|webp)$")


def browser_app(app: Column) -> Column:
    return app.rlike("(?i)chrome|firefox|safari|edge|brave|opera")


def infer_blank_url(title: Column) -> Column:
    """The site of a blank tab by its title."""
    found = F.lit(None).cast("string")
    for name, site in reversed(fixed.BLANK_TAB_SITES):
        found = F.when(title.contains(name), site).otherwise(found)
    return found


def combine_screenshot(caption: Column, text: Column) -> Column:
    mark = lambda label, v: F.when(F.coalesce(trim_all(v), F.lit("")) != "", F.concat(F.lit(f"[{label}: "), v, F.lit("]")))
    both = F.concat_ws(" ", mark("Caption", caption), mark("Text", text))
    return F.when(both == "", F.lit("[Screenshot]")).otherwise(both)


def bracketed(content: Column, label: str) -> Column:
    """What stands in the first [label: ...], to the bracket that closes it; null if there is none, it stays open, or it is blank. Folds over the pieces between brackets."""
    start = F.locate(f"[{label}:", content)
    head = len(label) + 2

    def step(s: Column, piece: Column) -> Column:
        depth = s.depth + F.when(piece.startswith("["), 1).when(piece.startswith("]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s.used + F.length(piece)).alias("used"), F.when(s.end.isNull() & (depth == 0), s.used).otherwise(s.end).alias("end"))

    def inner(tail: Column) -> Column:
        begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(None).cast("int").alias("end"))
        end = F.aggregate(F.split(tail, r"(?=[\[\]])"), begin, step, lambda s: s.end)
        return let(trim_all(F.substring(tail, F.lit(head + 1), end - head)), lambda v: F.when(v != "", v))

    return F.when(start > 0, let(F.substring(content, start, F.length(content)), inner))


def split_screenshot(content: Column) -> Column:
    """Caption and text of a combined screenshot; brackets inside them must be balanced."""
    return F.struct(bracketed(content, "Caption").alias("caption"), bracketed(content, "Text").alias("text"))


def screenshot_summary(caption: Column, text: Column) -> Column:
    usable = (F.coalesce(caption, F.lit("")) != "") & ~F.coalesce(caption, F.lit("")).startswith("Screenshot")
    part = truncate(F.when(usable, caption).otherwise(F.coalesce(text, F.lit(""))), 100)
    return F.when(part == "", F.lit("Screenshot content")).otherwise(truncate(part, 150))


def preview(x: Column, max_length: int) -> Column:
    kind = structure(x)
    flat = collapse(x)
    mark = F.when(kind != "Plain", F.concat(F.lit("["), kind, F.lit("]")))
    body = F.when(F.length(flat) > max_length, F.concat(F.substring(flat, 1, max_length), F.lit("..."))).when(flat != "", flat)
    return F.concat_ws(" ", mark, F.get(extract_all(x, fixed.URL_PATTERN), 0), body)


def relative_date(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    number = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    days = F.floor(minutes / 1440)
    return (
        F.when(minutes < 60, number(minutes, "m ago")).when(minutes < 1440, number(F.floor(minutes / 60), "h ago"))
        .when(days == 1, F.lit("Yesterday")).when(days < 7, number(days, "d ago")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def parse_timestamp(x: Column) -> Column:
    """Either encoding, with T and zone or with a blank, as UTC."""
    return F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))


def clean_minimal(x: Column) -> Column:
    """Without NULs and blank lines."""
    return F.array_join(F.filter(F.split(F.replace(x, F.lit("\x00"), F.lit("")), "\n"), lambda v: trim_all(v) != ""), "\n")


def fix_confusion(x: Column) -> Column:
    for word, right in fixed.CONFUSED_WORDS:
        x = F.regexp_replace(x, rf"(?U)\b{word}\b", right)
    return F.replace(F.translate(x, fixed.CONFUSED_FROM, fixed.CONFUSED_TO), F.lit("…"), F.lit("..."))


def drop_noise_characters(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[\x0B\x0C 　\x85]", " "), f"[^{fixed.KEPT_CHARACTERS}]", "")


def _lines_where(x: Column, keep) -> Column:
    return F.array_join(F.filter(F.transform(lines(x), trim_all), keep), "\n")


def drop_ui_noise(x: Column) -> Column:
    noise = "(?U)" + "|".join(fixed.NOISE_PATTERNS)
    single = lambda v: (F.octet_length(v) == 1) & ~v.isin("I", "a", "A")
    return _lines_where(x, lambda v: (v != "") & ~v.rlike(noise) & ~single(v) & ~F.lower(v).isin(*fixed.NOISE_WORDS))


def drop_fragments(x: Column) -> Column:
    def cleaned(v: Column) -> Column:
        kept = _lines_where(v, lambda line: (line != "") & (line.rlike(r"[\p{L}\p{N}]") | (F.octet_length(line) >= 3)))
        longest = trim_all(F.get(F.array_sort(lines(v), lambda a, b: F.octet_length(b) - F.octet_length(a)), 0))
        return let(kept, lambda k: F.when((k == "") & (v != ""), longest).otherwise(k))

    return let(x, cleaned)


def clean_balanced(x: Column) -> Column:
    """The pipeline after Unicode normalisation. Lines come out trimmed, so the last step only collapses their white space."""
    kept = drop_fragments(drop_ui_noise(drop_noise_characters(fix_confusion(x))))
    return trim_all(F.array_join(F.transform(lines(kept), collapse), "\n"))


def clean_screenshot(x: Column) -> Column:
    """Balanced cleaning, then without screenshot noise and lines with over twice as many symbols as letters."""
    noise = "(?U)" + "|".join(fixed.SCREENSHOT_NOISE)
    letters = lambda v: F.regexp_count(v, F.lit(r"\p{L}"))
    symbols = lambda v: F.regexp_count(v, F.lit(r"[^\p{L}\p{N}\s]"))
    return _lines_where(clean_balanced(x), lambda v: (v != "") & ~v.rlike(noise) & ~((letters(v) > 0) & (symbols(v) > 2 * letters(v))))


def quick_category(content: Column) -> Column:
    """The category where no keyword fits."""
    n, k, w = F.octet_length(content), F.size(lines(content)), F.size(words(content))
    note = (k > 8) & (n / k > 30) & (n / w > 4) & (n / w < 12)
    return F.when(note, "Notes").when((n < 100) | (w < 10), "Quick Notes").otherwise("Uncategorized")


def leading_words(content: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(words(F.lower(content)), 1, n), " ")


def keyword_scores(content: Column) -> Column:
    """rank (negative sum of weights) and category of each category with a keyword among the leading words, best first; ties by name."""
    rules = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category"), F.lit(w).alias("weight")) for k, c, _, w in fixed.CATEGORY_KEYWORDS))
    total = lambda hits, name: F.aggregate(F.filter(hits, lambda h: h.category == name), F.lit(0), lambda s, h: s - h.weight)
    rank = lambda hits: F.transform(F.array_distinct(F.transform(hits, lambda h: h.category)), lambda name: F.struct(total(hits, name).alias("rank"), name.alias("category")))
    return let(leading_words(content), lambda t: let(F.filter(rules, lambda r: t.contains(r.keyword)), lambda hits: F.array_sort(rank(hits))))


def keyword_category(content: Column) -> Column:
    return F.coalesce(F.get(keyword_scores(content), 0).getField("category"), quick_category(content))


def first_sentences(x: Column, n: int, longest: int) -> Column:
    """The first n sentences whose lengths add up to longest at most; null if the first is too long."""
    parts = F.filter(F.split(trim_all(x), r"(?<=[.!?])[ \n]"), lambda v: trim_all(v) != "")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def add(s: Column, v: Column) -> Column:
        fits = s.open & (s.used + F.length(v) <= longest)
        return F.struct(F.when(fits, s.used + F.length(v)).otherwise(s.used).alias("used"), F.when(fits, F.concat(s.kept, F.array(trim_all(v)))).otherwise(s.kept).alias("kept"), fits.alias("open"))

    return F.aggregate(F.slice(parts, 1, n), start, add, lambda s: F.when(F.size(s.kept) > 0, F.array_join(s.kept, " ")))


def json_object(x: Column) -> Column:
    """The outermost braces of a model's answer; an answer that goes on from a brace in its prompt gets it back."""
    goes_on = x.rlike(r'^\s*"') & x.contains("}")
    return F.when(goes_on, F.concat(F.lit("{"), F.regexp_extract(x, r"(?s)^(.*\})", 1))).otherwise(F.regexp_extract(x, r"(?s)(\{.*\})", 1))


def repaired_json(x: Column) -> Column:
    """The object in a model's answer as valid JSON, or null.

    Valid objects stay as they are. Else commas before closing brackets go and line
    ends become blanks.
    """
    valid = lambda v: F.when(F.try_parse_json(v).isNotNull(), v)

    def cleaned(v: Column) -> Column:
        for old, new in ((",}", "}"), (",]", "]"), ("\n", " "), ("  ", " ")):
            v = F.replace(v, F.lit(old), F.lit(new))
        return v

    return let(json_object(x), lambda v: F.when(v != "", F.coalesce(valid(v), valid(cleaned(v)))))


def parse_decision(x: Column) -> Column:
    """action, name, confidence of a model's category answer; confidence may be a number or a word in quotes and is kept between 0 and 1.

    An answer without an action that names a category is a creation. All three are null where
    there is no object to be read or no name in it.
    """

    def parts(body: Column) -> Column:
        get = lambda k: F.get_json_object(body, f"$.{k}")
        name = without_emoji(F.coalesce(get("name"), get("category_name"), get("category")))
        simple = get("action").isNull()
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get("confidence").try_cast("double"), F.when(simple, fixed.SIMPLE_CONFIDENCE).otherwise(0.5))))
        found = F.coalesce(name, F.lit("")) != ""
        return F.struct(F.when(found, F.coalesce(get("action"), F.lit("create_new"))).alias("action"), F.when(found, name).alias("name"), F.when(found, sure).alias("confidence"))

    return let(repaired_json(x), parts)


def clean_whitespace(x: Column) -> Column:
    """Text with its white space collapsed, but for code.

    A line that begins with four blanks or a tab opens a block of code, one without a
    blank at its start closes it; lines in between keep their indentation, and so do single
    lines that look like code. Three line ends or more become two.
    """
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        blank = trim_all(line) == ""
        lead = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        code = F.when(blank, s.code).when((lead >= 4) | line.startswith("\t"), True).when(lead == 0, False).otherwise(s.code)
        looks = line.rlike(fixed.COMMAND_LINE_PATTERN) | line.rlike(fixed.CODE_PATTERN) | has_any(line, fixed.CODE_WORDS)
        kept = F.when(code | looks, F.regexp_replace(line, r"^\t+", "    ")).otherwise(collapse(line))
        one = F.when(blank & ~s.code & (F.size(s.kept) == 0), F.array().cast("array<string>")).otherwise(F.array(F.when(blank, "").otherwise(kept)))
        return F.struct(code.alias("code"), F.concat(s.kept, one).alias("kept"))

    joined = F.aggregate(lines(x), start, step, lambda s: F.array_join(s.kept, "\n"))
    return trim_all(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def answer_summary(x: Column) -> Column:
    """The summary of a model's answer, whole JSON or not, else its first sentences without braces."""
    found = F.regexp_extract(x, r'(?s)"summary"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.when(found != "", truncate(trim_all(found), 200)).otherwise(first_sentences(F.translate(x, "{}", ""), 3, 200))


def fallback_category(content: Column, kind: Column) -> Column:
    """A name from keyword rules, else the first longer words of the first sentence, else the type's."""

    def chosen(start: Column) -> Column:
        low = F.lower(start)
        business = F.lit(None).cast("string")
        for keyword, name in reversed(fixed.FALLBACK_BUSINESS):
            business = F.when(low.contains(keyword), name).otherwise(business)
        for keywords, name in reversed(fixed.FALLBACK_INDUSTRY):
            business = F.when(business.isNotNull() & has_any(low, keywords), name).otherwise(business)
        proposal, yes, no = fixed.FALLBACK_PROPOSAL
        product = F.when(has_any(low, fixed.FALLBACK_PRODUCT), F.when(has_any(low, proposal), yes).otherwise(no))
        command = F.when(kind == "command", dict(fixed.FALLBACK_TYPES)["command"])
        topics = F.coalesce(*(F.when(has_any(low, keywords), name) for keywords, name in fixed.FALLBACK_TOPICS))
        first = F.slice(F.filter(words(F.regexp_extract(start, r"(?s)^([^.!?]*)", 1)), lambda w: (F.octet_length(w) > 3) & w.rlike(r"^\p{L}+$")), 1, 3)
        title = F.concat(F.array_join(F.transform(first, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " "), F.lit(" Content"))
        last = F.coalesce(*(F.when(kind == t, name) for t, name in fixed.FALLBACK_TYPES), F.lit(fixed.FALLBACK_LAST))
        return F.coalesce(business, product, command, topics, F.when(F.size(first) >= 2, title), last)

    return let(F.substring(content, 1, fixed.FALLBACK_LENGTH), chosen)
