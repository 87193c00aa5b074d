"""Column functions over texts, paths and names; all of them stay in the JVM."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for ranking (Portuguese and English).
STOP_WORDS = """
de da do das dos o a os as um uma uns umas para por com sem em no na nos nas que se ser estar tem ter mais menos quando
onde como qual esse essa isso este esta isto aquele aquela aquilo meu minha seu sua nosso nossa
the and or of to in is at on for with from but not this that these those are was were be been have has
""".split()
#: Shortest term that is indexed.
SHORTEST = 3
LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"
# What a failed fetch says when it lacks credentials.
AUTH_FAILURE = "(?i)" + "|".join((
    "authentication failed", "could not read username", "could not read password", "interactivity has been disabled", "terminal prompts disabled",
    "invalid credentials", "http basic: access denied", "access denied", r"\b401\b", r"\b403\b"))


def _folds() -> tuple[str, str, str, dict[str, str]]:
    """By Unicode's own decompositions (NFKD without combining marks): characters that become one ASCII letter or digit, what they
    become, the marks themselves, and characters that become several, of which some are ASCII letters or digits."""
    one, to, marks, several = [], [], [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(bare) == 1 and bare.isascii() and bare.isalnum():
                one.append(c)
                to.append(bare)
            elif any(x.isascii() and x.isalnum() for x in bare):
                several[c] = bare
    return "".join(one), "".join(to), "".join(marks), several


MARKED, PLAIN, MARKS, SEVERAL = _folds()
#: Stands for the characters that become several; a text that holds it is only looked at once more.
ONE_OF_SEVERAL = "\ufffe"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_accents(text: Column) -> Column:
    """Letters and digits without their marks, where ASCII ones remain; ligatures, fractions and the like in full.

    Texts of ASCII alone are passed through. Of the others one pass also tells whether any character becomes several.
    """
    names = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string,string>")

    def in_full(t: Column) -> Column:
        return F.array_join(F.transform(F.split(F.translate(t, MARKED + MARKS, PLAIN), ""), lambda c: F.coalesce(names[c], c)), "")

    def folded(t: Column) -> Column:
        bare = F.array(F.translate(t, MARKED + "".join(SEVERAL) + MARKS, PLAIN + ONE_OF_SEVERAL * len(SEVERAL)))
        told = F.transform(bare, lambda b: F.when(F.contains(b, F.lit(ONE_OF_SEVERAL)), in_full(t)).otherwise(b))
        return F.when(F.octet_length(t) == F.length(t), t).otherwise(told[0])

    # functions over one element work each text out once, however it was made
    return F.transform(F.array(text), folded)[0]


def words(text: Column) -> Column:
    """Lower-case runs of SHORTEST letters or digits or more, without marks; stop words are still there."""
    return F.regexp_extract_all(strip_accents(F.lower(text_or_empty(text))), F.lit(f"[a-z0-9]{{{SHORTEST},}}"), F.lit(0))


def is_term(word: Column) -> Column:
    return ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case terms without marks, of three characters or more, without stop words; none for null.

    Where terms are exploded anyway, ``words`` and ``is_term`` do it in generated code.
    """
    return F.filter(words(text), is_term)


def term_set(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text_or_empty(text)) / 4)).cast("long")


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def excerpt(text: Column, n: int = 1200, marker: str = "\n[...truncated]") -> Column:
    """The first n characters, with a marker where there are more."""
    return F.when(F.length(text) > n, F.concat(clip(text, n), F.lit(marker))).otherwise(text)


def first_line(text: Column, n: int = 200) -> Column:
    """First line that is neither blank, a heading nor a fence, else the first that is not blank; cut to n characters."""
    lines = F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x))
    full = F.filter(lines, lambda x: x != "")
    usable = F.filter(full, lambda x: ~x.startswith("#") & ~x.startswith("---"))
    return clip(F.coalesce(F.get(usable, F.lit(0)), F.get(full, F.lit(0)), F.lit("")), n)


def describe(description: Column, title: Column, body: Column, n: int = 200) -> Column:
    """Description, else title, else the body's first usable line."""
    empty_is_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    return clip(F.coalesce(empty_is_null(description), empty_is_null(title), first_line(body, n)), n)


def claim(description: Column, body: Column, n: int = 1200) -> Column:
    """What a note claims: its description, its title line, and the paragraph before the first section."""
    lead = F.split(text_or_empty(body), r"\n## ", 2)[0]
    title = F.regexp_extract(lead, r"(?m)^# (.*)$", 1)
    rest = F.regexp_replace(F.regexp_replace(lead, r"(?m)^#.*$", ""), r"^\s+|\s+$", "")
    paragraph = F.split(rest, r"\n\s*\n", 2)[0]
    return clip(F.array_join(F.filter(F.array(text_or_empty(description), title, paragraph), lambda x: x != ""), "\n"), n)


def drop_field(text: Column, field: str) -> Column:
    """Remove a front-matter field and the indented lines below it."""
    return F.regexp_replace(text, rf"(?m)^{field}:.*\n(?:[ \t]+.*\n|-.*\n)*", "")


def scope_of(path: Column) -> Column:
    """workspace, project, ticket or index by the path's segments; null where it is not a note."""
    parts = F.split(path, "/")
    n, name = F.size(parts), F.element_at(parts, -1)
    at = lambda i: F.get(parts, F.lit(i))
    return (
        F.when((n < 3) | ~path.endswith(".md"), None)
        .when(at(1) == "Learnings", "workspace")
        .when((n == 4) & (at(2) == "Learnings"), "project")
        .when((n >= 4) & (name == "_index.md"), "index")
        .when(F.array_contains(F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0))), "Learnings"), "ticket"))


def ticket_dir(path: Column) -> Column:
    """Folder of the ticket that a note or ticket index belongs to; null where there is none."""
    return (F.when(path.endswith("/_index.md"), F.regexp_replace(path, "/_index\\.md$", ""))
            .when(path.contains("/Learnings/"), F.substring_index(path, "/Learnings/", 1)))


def learnings_dir(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "^(.*/Learnings)/", 1), F.lit(""))


def is_learning(path: Column) -> Column:
    return path.contains("/Learnings/") & path.endswith(".md") & ~path.endswith("/_index.md")


def stem(path: Column) -> Column:
    """Lower-case file name without .md: the key that citations and reads are matched by."""
    name = F.trim(F.substring_index(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1))
    return F.lower(F.trim(F.regexp_replace(name, r"(?i)\.md$", "")))


def note_name(name: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.md)?$", 1))


def wiki_links(text: Column, most: int = 10) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(LINK), F.lit(1)), lambda x: F.trim(x)), 1, most)


def link_key(target: Column) -> Column:
    """The name that a link is looked up by: its last path segment, without .md."""
    return F.regexp_replace(F.substring_index(F.trim(target), "/", -1), r"\.md$", "")


def mentioned(text: Column) -> Column:
    """Distinct names that a text's links end in, whatever path is before them and alias after them; all links count."""
    inner = F.regexp_extract_all(text_or_empty(text), F.lit(r"\[\[([^\]|]*)(?:\||\]\])"), F.lit(1))
    return F.array_distinct(F.transform(inner, lambda x: F.substring_index(x, "/", -1)))


def repoint(text: Column, old: str, new: str) -> Column:
    """Let links to ``old``, with or without a path before it, point to ``new``, with their aliases."""
    return F.regexp_replace(text, r"\[\[(?:[^\]|]*/)?\Q" + old + r"\E(\|[^\]]*)?\]\]", "[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$1]]")


def split_branch(branch: Column) -> Column:
    """(type, slug): the parts before and after the first slash; type is empty where there is none."""
    cut = F.instr(branch, "/")
    return F.struct(F.when(cut > 0, F.substring_index(branch, "/", 1)).otherwise("").alias("type"),
                    F.when(cut > 0, F.substr(branch, cut + 1)).otherwise(branch).alias("slug"))


def branch_label(branch: Column) -> Column:
    short = F.regexp_extract(branch, r"^([^/]+/(?:\d+|[A-Za-z]+-\d+))", 1)
    return F.when(short == "", branch).otherwise(short)


def pair_label(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, -2, 2), "/")


def url_normalize(url: Column) -> Column:
    """Owner and name of a repository whatever host mirrors it: lower case, without scheme, host, trailing slashes and .git; null for nothing."""
    u = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    u = F.regexp_replace(F.regexp_replace(u, r"\.git$", ""), r"^(git@|https?://)[^/:]+[/:]", "")
    return F.nullif(F.lower(u), F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a URL or scp-form origin, lower case; empty for files, paths and null."""
    u = F.trim(text_or_empty(url))
    by_scheme = F.regexp_extract(u, r"^[A-Za-z+]+://(?:[^/@]+@)?([^/:]+)", 1)
    scp = F.regexp_extract(u, r"^(?:[^@/]+@)([^:/]+):", 1)
    return F.lower(F.when(by_scheme != "", by_scheme).otherwise(scp))


def encode_cwd(path: Column) -> Column:
    return F.regexp_replace(path, r"[:/\\_]", "-")


def clean_session_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^a-zA-Z0-9\-_]", "")


def symbols(text: Column, shortest: int = 6, most: int = 6) -> Column:
    """Code symbols of a note: back-ticked identifiers (their last dotted part too) and camel-case words, longest first, then as first seen."""
    ticked = F.regexp_extract_all(text_or_empty(text), F.lit(r"`([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)`"), F.lit(1))
    ticked = F.flatten(F.transform(ticked, lambda x: F.array(x, F.substring_index(x, ".", -1))))
    camel = F.regexp_extract_all(text_or_empty(text), F.lit(r"\b([A-Z][a-z0-9]+[A-Z][A-Za-z0-9]{3,})\b"), F.lit(1))
    found = F.array_distinct(F.concat(F.filter(ticked, lambda x: F.length(x) >= shortest), camel))
    keyed = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), x.alias("s"))))
    return F.slice(F.transform(keyed, lambda x: x["s"]), 1, most)


def counts_marker(text: Column) -> Column:
    """adds, confirms, adjusts and refutes of the first line with ``COUNTS:``, in any order, case and spacing; null unless all four are there."""
    line = F.regexp_extract(text_or_empty(text), r"(?i)COUNTS:[ \t]*([^\n]+)", 1)
    # of a repeated name the last number holds
    number = lambda k: F.nullif(F.regexp_extract(line, rf"(?i)^.*{k}\s*=\s*(\d+)", 1), F.lit("")).cast("long")
    names = ("adds", "confirms", "adjusts", "refutes")
    complete = F.lit(True)
    for k in names:
        complete = complete & number(k).isNotNull()
    return F.when(complete, F.struct(*(number(k).alias(k) for k in names)))


def _between(text: Column, start: str, end: str) -> Column:
    """What stands between two marker lines, without white space around it; empty where it is missing."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?s){start}\s*\n(.*?)\n{end}", 1), r"^\s+|\s+$", "")


def verdict(text: Column) -> Column:
    """(verdict, confidence, reason, trimmed) of a judge's answer: KEEP, TRIM or DROP; confidence is low unless it says high.

    Null where there is no such verdict, and for a TRIM without a body between its marker lines; a null counts as KEEP.
    """
    t = text_or_empty(text)
    said = F.upper(F.regexp_extract(t, r"(?mi)^\s*VERDICT:\s*(KEEP|TRIM|DROP)\b", 1))
    confidence = F.lower(F.regexp_extract(t, r"(?mi)^\s*CONFIDENCE:\s*(high|low)\b", 1))
    reason = F.substring(F.trim(F.regexp_extract(t, r"(?mi)^\s*REASON:\s*(.+)$", 1)), 1, 300)
    body = _between(t, "---TRIMMED---", "---END---")
    trimmed = F.when(said == "TRIM", F.concat(body, F.lit("\n")))
    usable = (said != "") & ((said != "TRIM") | (body != ""))
    return F.when(usable, F.struct(
        said.alias("verdict"), F.when(confidence == "", "low").otherwise(confidence).alias("confidence"), reason.alias("reason"), trimmed.alias("trimmed")))


def merge_decision(text: Column) -> Column:
    """(decision, body) of a resolver's answer: KEEP_BOTH or MERGE; null, which counts as KEEP_BOTH, where it says neither or a MERGE has no body."""
    t = text_or_empty(text)
    both = t.rlike(r"(?mi)^\s*DECISION:\s*KEEP_BOTH\b")
    body = _between(t, "---BODY---", "---END---")
    merge = t.rlike(r"(?mi)^\s*DECISION:\s*MERGE\b") & (body != "")
    return F.when(both, F.struct(F.lit("KEEP_BOTH").alias("decision"), F.lit(None).cast("string").alias("body"))).when(
        merge, F.struct(F.lit("MERGE").alias("decision"), F.concat(body, F.lit("\n")).alias("body")))


def fill(template: Column | str, **values: Column) -> Column:
    """A template with each ``<<NAME>>`` replaced by its value."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<<{name}>>"), text_or_empty(value))
    return out


def tier_glyph(tier: Column) -> Column:
    """One letter for each tier, a dash for none."""
    return F.when(tier == "high", "H").when(tier == "mid", "M").when(tier == "low", "L").otherwise("-")


def query_text(branch: Column, subjects: Column, stat: Column) -> Column:
    """What a branch is searched by: its name, its first ten subjects and the head of its statistics."""
    return F.concat_ws(" | ", text_or_empty(branch), F.array_join(F.slice(subjects, 1, 10), " | "), F.substring(text_or_empty(stat), 1, 1500))


def is_vault_read(path: Column, root: str) -> Column:
    """Does a read path lie in the vault, whatever its case and slashes?"""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = root.replace("\\", "/").rstrip("/").lower()
    return F.coalesce((plain == base) | plain.startswith(base + "/"), F.lit(False))


def project_of(path: Column) -> Column:
    """The second path segment, or the only one."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def thousands(n: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(n, 0)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def version_triple(version: Column) -> Column:
    numbers = F.transform(F.slice(F.regexp_extract_all(text_or_empty(version), F.lit(r"\d+"), F.lit(0)), 1, 3), lambda x: x.cast("int"))
    return F.concat(numbers, F.array_repeat(F.lit(0), 3 - F.size(numbers)))


def clock_times(values: Column) -> Column:
    """Valid HH:MM times, two digits each, distinct and sorted."""
    valid = F.filter(values, lambda v: v.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]\d\s*$"))
    return F.array_sort(F.array_distinct(F.transform(valid, lambda v: F.lpad(F.trim(v), 5, "0"))))


def percent_bar(share: Column, width: int = 18) -> Column:
    full = F.round(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("] "), F.format_string("%.1f%%", share * 100))


def front_matter(text: Column) -> Column:
    """Front matter as a map from lower-case key to a list of values.

    The block starts with the file and ends at the next line of dashes. A value is a scalar, an inline
    list or indented dashes on the lines below; quotes around values go.
    """
    unix = unix_lines(text_or_empty(text))
    block = F.regexp_extract(unix, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    entries = F.regexp_extract_all(block, F.lit(r"(?m)^([^\s:#-][^:\n]*:.*(?:\n(?:[ \t]+.*|-.*))*)"), F.lit(1))
    bare = lambda v: F.regexp_replace(F.trim(v), r"^(['\"])(.*)\1$", "$2")

    def values(entry: Column) -> Column:
        rest = F.regexp_replace(F.substr(entry, F.instr(entry, ":") + 1), r"^\s+|\s+$", "")
        inline = F.split(F.regexp_replace(rest, r"^\[|\]$", ""), ",")
        below = F.regexp_extract_all(rest, F.lit(r"(?m)^\s*-\s*(.*)$"), F.lit(1))
        chosen = F.when(rest.rlike(r"(?s)^\[.*\]$"), inline).when(rest.rlike(r"^-(\s|$)"), below).otherwise(F.array(rest))
        return F.filter(F.transform(chosen, bare), lambda v: v != "")

    pairs = F.transform(entries, lambda e: F.struct(F.lower(F.trim(F.substring_index(e, ":", 1))).alias("key"), values(e).alias("value")))
    # of a repeated key the last value holds
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))
    # as the one element of an array the pairs have a name; written out, the text would be parsed anew for each of them
    return F.map_from_entries(F.transform(F.array(pairs), last)[0])


def note_body(text: Column) -> Column:
    return F.trim(F.regexp_replace(unix_lines(text_or_empty(text)), r"(?s)\A---\n.*?\n---(?:\n|\z)", ""))


# How the sections of a shown text begin, line by line; before the first of them is the header.
SECTIONS = (("## Top matches", "matches"), ("## No strong match", "matches"), ("### Body excerpt", "body_excerpt"), ("## Related (GraphRAG", "graphrag"),
            ("## Current ticket:", "ticket"), ("Read body:", "footer"), ("</vault-context>", "footer"))


def section_tokens(output: Column) -> Column:
    """Token estimates of a shown text by section, for the sections that it has."""
    heads = F.create_map(*(F.lit(x) for pair in SECTIONS for x in pair))
    begin = r"^ *(" + "|".join(f"\\Q{begin}\\E" for begin, _ in SECTIONS) + ")"
    lines = F.filter(F.split(output, r"(?s)(?<=\n)(?=.)"), lambda x: x != "")
    told = F.transform(lines, lambda x: F.struct(F.try_element_at(heads, F.regexp_extract(x, begin, 1)).alias("head"), F.octet_length(x).cast("long").alias("bytes")))

    def step(acc: Column, line: Column) -> Column:
        now = F.coalesce(line["head"], acc["now"])
        return F.struct(now.alias("now"), F.concat(acc["said"], F.array(F.struct(now.alias("section"), line["bytes"].alias("bytes")))).alias("said"))

    def finish(acc: Column) -> Column:
        """Here the lines are a variable; outside, each use of them would read the text anew."""
        said = acc["said"]
        total = lambda n: F.aggregate(said, F.lit(0).cast("long"), lambda a, x: F.when(x["section"] == n, a + x["bytes"]).otherwise(a))
        names = F.array_distinct(F.transform(said, lambda x: x["section"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.greatest(F.lit(1).cast("long"), F.floor(total(n) / 4)))))

    start = F.struct(F.lit("header").alias("now"), F.array().cast("array<struct<section:string,bytes:bigint>>").alias("said"))
    return F.aggregate(told, start, step, finish)


def cited_keys(output: Column) -> Column:
    """Names of the notes that a text links to, as ``stem`` gives them, each once."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(output, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: stem(F.trim(x))), lambda x: x != ""))


def patch_status(raw: Column, status: Column) -> Column:
    """A note's text with ``status:`` set in its front matter, the first such line or a new last one; null where the text has no front matter."""
    end = F.instr(F.substr(raw, F.lit(4)), F.lit("\n---")) + 3
    head, rest = F.substr(raw, F.lit(1), end - 1), F.substr(raw, end)
    # of the lines the first that sets it, with what stands before and after
    before = F.regexp_extract(head, r"(?s)\A(.*?)(?<![^\n])status:[^\n]*", 1)
    after = F.regexp_extract(head, r"(?s)\A.*?(?<![^\n])status:[^\n]*(.*)\z", 1)
    patched = F.when(head.rlike(r"(?<![^\n])status:"), F.concat(before, F.lit("status: "), status, after)).otherwise(F.concat(F.rtrim(head, F.lit("\n")), F.lit("\nstatus: "), status, F.lit("\n")))
    return F.when(raw.startswith("---") & (end > 3), F.concat(patched, rest))
