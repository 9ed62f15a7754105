"""Column functions over prompts, paths, models and numbers. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 50
# Short replies that need the previous turn's context to be understood.
SHORT_PROMPTS = ["y", "yes", "n", "no", "ok", "okay", "진행", "다음", "네", "응", "예", "아니", "아니오", "계속", "go", "yep", "nope", "확인"]
SHORT_CHARS, HINT_CHARS = 4, 60
_SPACE = r"^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def slash_skill(prompt: Column) -> Column:
    """Name of a /skill prompt, or null."""
    return none_if_empty(F.regexp_extract(stripped(prompt), r"^/(\S+)", 1))


def request_line(prompt: Column) -> Column:
    """First line with text after the header line of a wrapped request, or of the whole prompt without one."""
    lines = F.split(F.coalesce(prompt, F.lit("")), r"\r\n|\r|\n")
    header = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit("my request for codex:"))), True)
    rest = F.filter(F.transform(F.slice(lines, F.greatest(header, F.lit(0)).cast("int") + 1, F.size(lines)), stripped), lambda x: x != "")
    return F.get(rest, F.lit(0))


def dollar_skill(prompt: Column, known: list[str] | None = None) -> Column:
    """Name of a $skill prompt: a link to a skill file, or a token that is a known name, or without a list of names one
    that looks like a command."""
    line = request_line(prompt)
    link = F.regexp_extract(line, r"^\[\$(\p{L}[\p{L}\p{M}\p{N}_:-]*)\]\(([^)]*)\)", 1)
    target = stripped(F.regexp_extract(line, r"^\[\$[^\]]*\]\(([^)]*)\)", 1))
    valid = (F.endswith(target, F.lit("/SKILL.md")) | (target == "SKILL.md")) & (F.contains(target, F.lit("/skills/")) | F.contains(target, F.lit("/.agents/")))
    token = F.regexp_extract(line, r"^\$(\p{L}[\p{L}\p{M}\p{N}_:-]*)(?:\s|$)", 1)
    meant = token.isin(known) if known is not None else token.rlike(r"^\p{Ll}") & ((token == "imagegen") | token.rlike("[-:]"))
    return F.when((link != "") & valid, link).when((token != "") & meant, token)


def skill_name(prompt: Column, known: list[str] | None = None) -> Column:
    return F.coalesce(slash_skill(prompt), dollar_skill(prompt, known))


def clean_prompt(text: Column) -> Column:
    """One line of a prompt: image marks replaced, mentioned paths cut to their last part, white space as one space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[Image source:[^\]]*\]", "")
    out = F.regexp_replace(out, r"\[Image #\d+\]", "🖼")
    out = F.regexp_replace(out, r'@/(?:[^\s)\]"/]+/)*([^\s)\]"/]+\.[A-Za-z0-9]{1,8})(?=$|[\s)\]"])', "@$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\n\r]", " "), " {2,}", " "), r"^[ \t]+|[ \t]+$", "")


def truncated(text: Column, most: int = PREVIEW_CHARS) -> Column:
    """At most so many characters, with an ellipsis where some are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"[ \t]+$", ""), F.lit("…")))


def preview(text: Column, compact: Column, images: Column) -> Column:
    cleaned = clean_prompt(text)
    shown = F.when(images, F.concat(F.lit("🖼 "), truncated(cleaned, PREVIEW_CHARS - 2))).otherwise(truncated(cleaned))
    return F.when(compact, "↻ Compact resume").when(cleaned == "", F.when(images, "🖼 (image only)").otherwise("(empty)")).otherwise(shown)


def file_paths(text: Column) -> Column:
    """Absolute paths with an extension that a text mentions outside of code marks, in order, each once."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"```[\s\S]*?```", " "), r"`[^`\n]*`", " ")
    tokens = F.split(F.replace(plain, F.lit("\\ "), F.lit("\x01")), r"[\s\[\]()]+")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\x01"), F.lit(" ")), r"""[.,;:!?)\]}"']+$""", ""), "^@/", "/"))
    return F.array_distinct(F.filter(bare, lambda t: t.rlike(r"^/(?:.*/)?[^/]+\.[\p{L}\p{N}]{1,8}$")))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0)))


def markdown_targets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))


def quoted_paths(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""["'](/[^"'\n]+\.[A-Za-z0-9]{1,8})["']"""), F.lit(1)))


def project_label(path: Column) -> Column:
    """Last part of a path, or of a name whose parts are joined by dashes."""
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    dashed = F.regexp_extract(path, "([^-]+)-*$", 1)
    return F.when(path == "", "").when(F.contains(path, F.lit("/")) & (last != ""), last).when(dashed != "", dashed).otherwise(path)


def decoded_path(name: Column) -> Column:
    """The path that an encoded project folder stands for."""
    slashes = F.replace(F.replace(name, F.lit("--"), F.lit("/_")), F.lit("-"), F.lit("/"))
    return F.when(name == "", "/").when(F.startswith(slashes, F.lit("/")), slashes).otherwise(F.concat(F.lit("/"), slashes))


def is_short(prompt: Column) -> Column:
    text = stripped(prompt)
    return (text != "") & (F.lower(text).isin(SHORT_PROMPTS) | (F.length(text) <= SHORT_CHARS))


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    return F.get(lines, F.lit(0))


def prompt_hint(prompt: Column, previous_closing: Column) -> Column:
    """For a short prompt the first line of what was said last before it."""
    return F.when(is_short(prompt), truncated(first_line(previous_closing), HINT_CHARS))


def tool_summary(name: Column, arguments: Column) -> Column:
    """One line for a tool call: its most telling argument."""
    get = lambda *keys: F.coalesce(*(F.get_json_object(arguments, f"$.{k}") for k in keys))
    base = F.regexp_extract(get("file_path", "notebook_path", "path"), "([^/]+)$", 1)
    return (
        F.when(name == "Bash", F.coalesce(get("description"), get("command"))).when(name.isin("Read", "Write", "Edit", "MultiEdit", "NotebookEdit"), base).when(name.isin("Grep", "Glob"), get("pattern"))
        .when(name == "WebFetch", get("url")).when(name == "WebSearch", get("query")).when(name.isin("Task", "Agent"), get("description")).when(name == "Skill", get("skill", "command")).otherwise(name)
    )


def tool_skill(name: Column, arguments: Column) -> Column:
    """Skill that a tool call starts."""
    return F.when(name == "Skill", none_if_empty(F.regexp_replace(F.coalesce(F.get_json_object(arguments, "$.skill"), F.get_json_object(arguments, "$.command"), F.lit("")), "^/", "")))


def fixed(x: Column, digits: int) -> Column:
    """Digits as C's printf rounds them: the binary value decides a tie."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def compact_number(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(fixed(n / 1000, 1), F.lit("k"))).otherwise(F.concat(fixed(n / 1_000_000, 1), F.lit("M")))


def compact_cost(usd: Column) -> Column:
    dollars = lambda digits: F.concat(F.lit("$"), fixed(usd, digits))
    return F.when(usd.isNull(), "—").when(usd < 0.0005, "<$0.001").when(usd < 1, dollars(3)).when(usd < 100, dollars(2)).otherwise(dollars(0))


def whole_cost(usd: Column) -> Column:
    return F.when(usd.isNull(), "—").when(usd < 0.5, "<$1").otherwise(F.concat(F.lit("$"), fixed(F.floor(usd + 0.5).cast("double"), 0)))


# How parts of a model's name are written.
_PARTS = {"api": "API", "oss": "OSS"}


def short_model(model: Column) -> Column:
    """Model names as shown: families by their short names, dated names of old form with the version at the end."""
    old = r"^claude-(\d+)(?:-(\d+))?-(\D.*)-\d{8}$"
    version = F.concat(F.regexp_extract(model, old, 1), F.when(F.regexp_extract(model, old, 2) != "", F.concat(F.lit("."), F.regexp_extract(model, old, 2))).otherwise(""))
    lower = F.lower(model)
    word = lambda w: F.coalesce(*(F.when(w == k, v) for k, v in _PARTS.items()), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    parts = lambda prefix: F.filter(F.split(F.substring(lower, F.lit(len(prefix) + 1), F.length(lower)), "-"), lambda x: x != "")
    gpt = F.concat_ws(" ", F.concat(F.lit("GPT-"), F.replace(F.get(parts("gpt-"), F.lit(0)), F.lit("oss"), F.lit("OSS"))), F.array_join(F.transform(F.slice(parts("gpt-"), 2, 100), word), " "))
    codex = F.concat_ws(" ", F.lit("Codex"), F.array_join(F.transform(parts("codex-"), word), " "))
    return F.when(model.rlike(old), F.concat(F.regexp_extract(model, old, 3), F.lit("-"), version)).when(F.startswith(model, F.lit("claude-")), F.substring(model, F.lit(8), F.length(model))).when(F.startswith(lower, F.lit("gpt-")), F.trim(gpt)).when(F.startswith(lower, F.lit("codex-")), F.trim(codex)).otherwise(model)


def contains_query(text: Column, query: str) -> Column:
    """Case-insensitive substring; an empty query matches nothing."""
    query = query.strip().lower()
    return F.contains(F.lower(text), F.lit(query)) if query else F.lit(False)
