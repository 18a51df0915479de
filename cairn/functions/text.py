"""Scalar and array expressions on paths, names and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    ".java": "java", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go",
    ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
}
ABSTAIN = "[INSUFFICIENT_EVIDENCE]"
#: The characters of white space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def strip(text: Column) -> Column:
    """Without white space at the ends, in time linear in the text."""
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.substring(F.btrim(F.concat(F.lit("."), text), F.lit(SPACES)), F.lit(2), F.length(text))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def language(path: Column, languages: dict[str, str] = LANGUAGES) -> Column:
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def validatable(path: Column) -> Column:
    return extension(path).isin(".java", ".py")


def doc_level(path: Column, label: Column) -> Column:
    """Level of a document by its folder label and path."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    synthesis = F.lower(path).contains("synthesis/") & name.rlike(r"^l\d+_")
    return (
        F.when(label == "reports", "report").when(label == "workspace", "code")
        .when(label != "context", "context")
        .when(synthesis, F.upper(F.regexp_extract(name, r"^(l\d+)_", 1)))
        .when(name.startswith("codex_"), "L3").otherwise("context")
    )


#: Rules (value, pattern) on a path, the first that fits counts; settings may bring others.
BLOCKS = (("backend", r"backend|\.(java|py)$"), ("frontend", r"frontend|\.(js|ts)$"), ("database", r"database|\.sql$"), ("tests", "test|spec"), ("infrastructure", "infra|deploy"))
CONTENT_TYPES = (("codex_doc", "codex_"), ("synthesis", "synthesis"), ("config", r"config|\.(yaml|yml|json)$"), ("test", "test|spec"))


def first_rule(path: Column, rules: tuple, otherwise: str) -> Column:
    """The value of the first rule whose pattern is found in the path."""
    found = F.lit(otherwise)
    for value, pattern in reversed(rules):
        found = F.when(path.rlike(pattern), value).otherwise(found)
    return found


def block(path: Column, rules: tuple = BLOCKS) -> Column:
    return first_rule(path, rules, "other")


def content_type(path: Column, label: Column, rules: tuple = CONTENT_TYPES) -> Column:
    return F.when(label == "workspace", "code").otherwise(first_rule(path, rules, "context"))


def module_path(path: Column) -> Column:
    """First part of a path of up to two parts, else the first two."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) <= 2, parts[0]).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def package_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/?[^/]*$", "")


def file_of_id(node: Column) -> Column:
    """The path in a `Type:path:line` id."""
    return F.regexp_extract(node, r"^[^:]+:(.*):[^:]*$", 1)


def is_node_id(name: Column) -> Column:
    return name.rlike("^(Module|Class|Method|Field):")


def simple_name(target: Column) -> Column:
    return F.regexp_replace(target, "^UnresolvedCall:", "")


def commit_url(remote: Column, sha: Column) -> Column:
    """Web address of a commit, for https and ssh remotes; GitLab has its own path."""
    web = F.regexp_replace(F.regexp_replace(remote, r"^git@([^:]+):", "https://$1/"), r"\.git$", "")
    return F.concat(web, F.when(web.contains("gitlab"), "/-/commit/").otherwise("/commit/"), sha)


def doc_name(path: Column, prefix: str = "codex_") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(path, r"[/\\.]", "_"), F.lit(".md"))


def redact_code(text: Column, most: int = 500) -> Column:
    """Prose without fenced blocks, cut to `most` characters."""
    return F.left(F.regexp_replace(text, r"(?s)```.*?```", "[code]"), F.lit(most))


def segments(stem: Column) -> Column:
    """Path parts in a document's name."""
    clean = F.regexp_replace(F.regexp_replace(stem, "^codex_", ""), r"_\d{8}_\d{6}$", "")
    return F.filter(F.split(clean, "_"), lambda s: s != "")


def sentences(text: Column, lines_too: bool = False) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+|\n" if lines_too else r"(?U)(?<=[.!?])\s+")


def abstains(text: Column) -> Column:
    return text.contains(ABSTAIN)


def strip_abstain(text: Column) -> Column:
    """Without lines that hold the marker only; elsewhere it reads (unknown)."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != ABSTAIN)
    return F.replace(F.array_join(lines, "\n"), F.lit(ABSTAIN), F.lit("(unknown)"))


#: Patterns of identifiers in source text, of which the first group is the name, and English words that are none.
DEFINITIONS = (r"\b(?:class|interface|enum|record)\s+([A-Z][A-Za-z0-9_]+)", r"\bdef\s+([a-z_][a-zA-Z0-9_]+)\s*\(")
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized")
TOKENS = (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z][a-z0-9_]{3,})\b", r"\b([a-z][a-z0-9_]+(?:\.[a-z][a-z0-9_]+)+)\b")
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "man", "new",
    "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use", "with", "this", "that", "from", "have", "will",
    "your", "what", "when", "make", "like", "time", "just", "know", "take", "people", "into", "year", "good", "some", "could", "them", "than", "then", "also", "very",
    "after", "should", "world", "would", "there", "their", "about", "which", "these", "those", "other", "such", "only", "more", "most", "many", "much", "here", "over",
    "under", "again", "further", "once", "where", "why", "before", "right", "too",
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), 1)


def methods(text: Column) -> Column:
    """Names before an opening bracket that a type stands before, and before that a modifier or any other word.

    Each run of words, blanks, commas and angle brackets before a bracket is looked at once, so that long prose takes no more than its length.
    """
    runs = _all(text, r"(?<![\w<>,\s])([\w<>,\s]++)\(")
    named = F.filter(F.transform(runs, lambda r: F.struct(r.alias("run"), F.regexp_extract(r, r"(?U)\s([a-z_][A-Za-z0-9_]+)\s*$", 1).alias("name"))), lambda x: x["name"] != "")
    before = F.transform(named, lambda x: F.struct(x["name"].alias("name"), F.regexp_replace(x["run"], r"(?U)\s+\S+\s*$", "").alias("rest")))
    typed = rf"(?U)\w\s+\w|\b(?:{'|'.join(MODIFIERS)})\w"
    return F.transform(F.filter(before, lambda x: x["rest"].rlike(typed)), lambda x: x["name"])


def identifiers(text: Column, stopwords: tuple | list = STOPWORDS) -> Column:
    """Distinct names of four characters or more: definitions, methods, then words that aren't stopwords."""
    defined = F.flatten(F.array(*[_all(text, p) for p in DEFINITIONS], methods(text)))
    words = F.flatten(F.array(*[_all(text, p) for p in TOKENS]))
    words = F.filter(words, lambda w: ~F.lower(w).isin(*stopwords)) if stopwords else words
    return F.array_sort(F.array_distinct(F.filter(F.concat(defined, words), lambda w: F.length(w) >= 4)))


def annotations(text: Column) -> Column:
    """Annotation names, and the parts of their string arguments."""
    literals = F.regexp_extract_all(text, F.lit(r'@[A-Z]\w*\s*\(\s*"([^"]+)"'), 1)
    pieces = F.filter(F.flatten(F.transform(literals, lambda x: F.split(x, r"[/.\-_]"))), lambda p: F.length(p) >= 3)
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"@([A-Z][A-Za-z0-9_]*)"), 1), pieces)))


#: Kinds of identifiers in prose.
CANDIDATES = (
    ("camelcase", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), ("snake_case", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), ("all_caps", r"\b([A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*)\b"),
    ("dotted", r"\b([A-Za-z_][A-Za-z0-9_]+(?:\.[A-Za-z_][A-Za-z0-9_]+)+)\b"), ("backticked", r"`([^`]+)`"),
)


def clean_backticked(token: Column) -> Column:
    """Without a leading @, from the first bracket or blank on, and punctuation around."""
    bare = F.regexp_replace(strip(token), "^@+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)(?<=.)[(\[< ].*$", ""), "^[.,:;\"'`]+|[.,:;\"'`]+$", "")


def candidates(text: Column) -> Column:
    """Array of (name, kind) in order of kinds, repeats included."""
    found = []
    for kind, pattern in CANDIDATES:
        names = _all(text, pattern)
        names = F.filter(F.transform(names, clean_backticked), lambda n: n != "") if kind == "backticked" else names
        found.append(F.transform(names, (lambda k: lambda n: F.struct(n.alias("name"), F.lit(k).alias("kind")))(kind)))
    return F.flatten(F.array(*found))
