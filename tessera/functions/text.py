"""Text expressions: token estimates, markers, paths, keywords, entities, redaction, previews and hashes.

The patterns use no look-around, so they mean the same in every regular-expression engine of the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openers of a message that changes the topic, matched at its start in any case.
TOPIC_SHIFT = r"""(?i)^(actually,?\s*(let'?s?|can we|could we)|(new|different|another)\s+(question|topic|issue)|switching\s+(to|gears)|(on|about)\s+a\s+(different|separate)\s+(note|topic)|(ok|okay),?\s*(so|now)\s+|moving\s+on|forget\s+(about\s+)?(that|this)|let'?s\s+(change|switch|move)|(unrelated|separate)\s*(question|topic|issue)?|(btw|by the way))"""
# Openers of a message that goes on with the topic.
CONTINUATION = r"""(?i)^((yes|no|right|correct|exactly)|(it|that|this)\s+(is|was|shows|works|doesn'?t)|(the|your)\s+(error|output|result|fix|solution)|(thanks|thank\s+you)|(ok|okay|got\s+it|makes\s+sense)|(but|however|although|though)|(also|additionally|and\s+also)|(what\s+about|how\s+about)|(can you|could you)\s+(also|explain|show)|(I\s+(see|understand|get\s+it)))"""
# First lines of a session that resumes another, case-sensitive, after one leading role tag.
RESUMED = r"^(\[(User|Assistant|Thinking)\]\n)?(This session is being continued from a previous conversation|Continuing from previous session|This is a continuation of|Resumed session)"
# File extensions that make a word a path.
EXTENSIONS = "ts tsx js jsx mjs cjs py pyi go rs java c cpp h hpp json yaml yml toml md txt html css scss sh bash zsh sql graphql dockerfile makefile".split()
FILE_PATH = r"""(?i)(?:^|\s|["`'(])([\w./-]+\.(?:""" + "|".join(EXTENSIONS) + r"""))(?:["`')]|\s|$|:)"""
DIR_PATH = r"""(?i)(?:^|\s|["`'(])((?:/|\./|\.\./|~/)?[\w.-]+(?:/[\w.-]+)+)(?:["`')]|\s|$|:)"""
# Words that are no keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must can "
    "it this that these those i you he she we they what which who when where why how all each every both few more most other some such no not only same so than too very just also "
    "now here there then if else because while although though after before until unless since let me my your its our their about into over under again further once during out up down off between through"
).split()
# Boilerplate lines of resumed sessions.
BOILERPLATE = (
    r"This session is being continued from a previous conversation[^\n]*",
    r"If you need specific details from before compaction[^\n]*",
    r"Please continue the conversation from where we left it off[^\n]*",
    r"Here is a summary of the conversation so far[^\n]*",
    r"The conversation has been compacted[^\n]*",
)
# What redaction replaces.
ABSOLUTE_PATH = r"(?:/[\w.-]+)+\.\w+|(?:[A-Z]:\\[\w.\-\\]+)|(?:~/[\w.\-/]+)"
FENCED = r"(?s)```.*?```"
# Entity patterns with the confidence of each.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
URL = r"""https?://[^\s<>"')\]]+"""
MENTION = r"@([a-zA-Z][a-zA-Z0-9._-]{0,30})\b"
CHANNEL = r"#([a-zA-Z][a-zA-Z0-9_-]{0,50})\b"
SAID = r"\b([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?)\s+(?:said|says|mentioned|asked|replied|suggested|noted|reported|confirmed|explained|wrote|responded)\b"
WITH_FROM = r"\b(?:with|from|by|to|cc|cc'd|cced)\s+([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?)\b"
MEETING = r"(?i)\b(standup|stand-up|retro|retrospective|1:1|one-on-one|sync|daily|weekly|sprint\s+review|sprint\s+planning|kick-?off|all-?hands)\b"
# Capitalised words that are no names.
NO_NAMES = (
    "i he she we they you it me him her us them my his our their your its the a an this that these those but and or so if when then also just now here there what who how why which where "
    "some all any each every not no yes maybe perhaps however therefore meanwhile otherwise furthermore additionally finally first second third next last error warning note todo fixme hack true false null undefined none"
).split()
USER_BLOCK = r"(?s)\[User\]\n(.*?)(?:\n\n\[|\z)"
_TRIMMED = r"^\s+|\s+$"


def approx_tokens(text: Column) -> Column:
    """ceil(characters / 3.5); 0 for null and empty texts."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.5).cast("int")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _TRIMMED, "")


def has_topic_shift(text: Column) -> Column:
    return trimmed(text).rlike(TOPIC_SHIFT)


def has_continuation(text: Column) -> Column:
    return trimmed(text).rlike(CONTINUATION)


def is_resumed(text: Column) -> Column:
    return text.rlike(RESUMED)


def user_text(chunk: Column) -> Column:
    """The text of the first user block of a rendered chunk; empty where there is none."""
    return F.regexp_extract(chunk, USER_BLOCK, 1)


def paths(text: Column) -> Column:
    """The distinct file and directory paths, lower-cased, without a leading ./"""
    found = F.concat(F.regexp_extract_all(text, F.lit(FILE_PATH), 1), F.regexp_extract_all(text, F.lit(DIR_PATH), 1))
    return F.array_distinct(F.transform(found, lambda p: F.lower(F.regexp_replace(p, r"^\./", ""))))


def keywords(text: Column) -> Column:
    """The distinct words of 3 letters or more that are neither stop words nor numbers."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    parts = F.split(F.lower(text), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets as intersection / union; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def code_blocks(text: Column) -> Column:
    """Fenced blocks: half of the fences, rounded down."""
    return F.floor(F.regexp_count(text, F.lit("```")) / 2).cast("int")


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, ABSOLUTE_PATH, "[REDACTED_PATH]")


def redact_code(text: Column) -> Column:
    return F.regexp_replace(text, FENCED, "```\n[REDACTED_CODE]\n```")


def without_boilerplate(text: Column) -> Column:
    for p in BOILERPLATE:
        text = F.regexp_replace(text, p, "")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def preview(text: Column, n: int) -> Column:
    """The first n characters on one line, with an ellipsis where the text goes on."""
    cut = F.translate(F.substring(text, 1, n), "\n", " ")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(cut)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column, n: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def chunk_id(session: Column, turns: Column, text: Column) -> Column:
    """Deterministic id: the session and 16 hex digits of the hash over session, turns and text."""
    return F.concat(session, F.lit("-"), short_hash(F.concat_ws(":", session, F.array_join(turns, ","), text), 16))


def sanitize_query(query: str) -> list[str]:
    """The terms of a keyword query: no operators in capitals, no special characters; all of them must match."""
    kept = " ".join(w for w in query.split() if w not in ("AND", "OR", "NOT"))
    return kept.translate(str.maketrans('*"(){}^~-', " " * 9)).split()


def human_duration(ms: Column) -> Column:
    """Milliseconds as whole seconds, or as minutes, hours or days with one decimal."""
    shown = lambda n, f, u: F.format_string(f + u, ms / float(n))
    return F.when(ms.isNull(), F.lit(None).cast("string")).when(ms < 60_000, shown(1000, "%.0f", "s")).when(ms < 3_600_000, shown(60_000, "%.1f", "m")).when(ms < 86_400_000, shown(3_600_000, "%.1f", "h")).otherwise(shown(86_400_000, "%.1f", "d"))


def time_ago(then: Column, now: Column) -> Column:
    """How long ago in whole units; the future is just now, null is unknown."""
    s = F.unix_seconds(now) - F.unix_seconds(then)

    def unit(n: int, name: str, many: str) -> Column:
        k = F.floor(s / n)
        return F.concat(k.cast("string"), F.when(k == 1, name).otherwise(many), F.lit(" ago"))

    return F.when(then.isNull(), "unknown").when(s < 60, "just now").when(s < 3600, unit(60, " min", " min")).when(s < 86_400, unit(3600, " hour", " hours")).otherwise(unit(86_400, " day", " days"))


def _first_lines(text: Column, most_tokens: int) -> Column:
    """The meaningful lines that fit a budget, joined by spaces (`text`, null if none), and the tokens `n` of all of them."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~x.rlike(r"^([-=_*]{3,}$|```|Tool:)"))
    # one pass: an expression in a lambda is worked out anew for every line
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + approx_tokens(x)
        taken = F.when(s["text"].isNull(), x).when(n <= most_tokens, F.concat(s["text"], F.lit(" "), x)).otherwise(s["text"])
        return F.struct(n.alias("n"), taken.alias("text"))

    return F.aggregate(lines, start, add)


def heuristic_description(text: Column, most_tokens: int = 130) -> Column:
    """The first meaningful lines (no separators, fences or tool lines) up to a token budget, joined by spaces.

    The first line is taken whatever its size; the result has at most 5 characters per token of the budget. Of a long text
    only the head is gone through if its whole lines exceed the budget, as no later line can be taken then.
    """
    some = 40 * most_tokens
    head = F.substring(text, 1, some)
    whole_lines = F.left(head, F.length(head) - F.length(F.substring_index(head, "\n", -1)))
    early, every = _first_lines(whole_lines, most_tokens), _first_lines(text, most_tokens)
    taken = F.when((F.length(text) > some) & (early["n"] > most_tokens), early["text"]).otherwise(F.when(text.isNotNull(), F.coalesce(every["text"], F.lit(""))))
    return F.substring(taken, 1, most_tokens * 5)


def relevant_text(chunk: Column) -> Column:
    """User and assistant blocks of a rendered chunk without thinking and fenced code; the text itself if unmarked."""
    marked = F.contains(chunk, F.lit("[User]")) | F.contains(chunk, F.lit("[Assistant]"))
    kept = F.regexp_replace(chunk, r"(?s)\[Thinking\].*?(?:(\[User\]|\[Assistant\])|\z)", "$1")
    kept = F.regexp_replace(F.regexp_replace(kept, r"(?s)\A.*?(\[User\]|\[Assistant\])", "$1"), r"\[(?:User|Assistant)\]", "")
    return F.regexp_replace(F.when(marked, kept).otherwise(chunk), FENCED, "")


def entities(text: Column) -> Column:
    """Mentions as array<struct<entity_type, mention_form, name, confidence>>, the first of each type and name.

    Runs over text as given (see relevant_text). In order: @mentions, #channels (hex colours are none), e-mail
    addresses, links, names in context (no listed common words), meeting words.
    """

    def of(pattern: str, group: int, kind: str, confidence: float, prefix: str = "", name=F.lower):
        found = F.regexp_extract_all(text, F.lit(pattern), group)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("entity_type"), F.concat(F.lit(prefix), m).alias("mention_form"), name(m).alias("name"), F.lit(confidence).alias("confidence")))

    block = F.array(*[F.lit(w) for w in NO_NAMES])
    is_name = lambda e: ~F.arrays_overlap(F.split(e["name"], r"\s+"), block)
    every = F.concat(
        of(MENTION, 1, "person", 0.95, "@"),
        F.filter(of(CHANNEL, 1, "channel", 0.95, "#"), lambda e: ~e["name"].rlike("^[0-9a-f]{3,8}$")),
        of(EMAIL, 0, "person", 0.9),
        of(URL, 0, "url", 1.0, name=lambda m: m),
        F.filter(of(SAID, 1, "person", 0.6), is_name),
        F.filter(of(WITH_FROM, 1, "person", 0.6), is_name),
        of(MEETING, 1, "meeting", 0.7, name=lambda m: F.regexp_replace(F.lower(m), r"\s+", "-")),
    )
    key = lambda e: F.concat(e["entity_type"], F.lit(":"), e["name"])
    return F.filter(every, lambda e, i: F.array_position(F.transform(every, key), key(e)) == i + 1)


def lcg_shuffle(items: list, seed: int) -> list:
    """A reproducible shuffle of a short list on the driver: Fisher-Yates from the end, with the generator below."""
    out, state = list(items), seed
    for i in range(len(out) - 1, 0, -1):
        state = (1664525 * state + 1013904223) % 2**31  # fixed values
        j = state * (i + 1) // 2**31
        out[i], out[j] = out[j], out[i]
    return out
