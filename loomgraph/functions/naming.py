"""Column functions: names, types, ids and hashes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracked names of command chains.
COMMANDS = {
    "analyze extract": "analyze_extract",
    "analyze select": "analyze_select",
    "analyze select-agent": "analyze_select",
    "generate components": "generate_components",
    "generate tokens": "generate_tokens",
    "generate edit": "generate_edit",
    "apply preview": "apply_preview",
    "apply select": "apply_select",
    "apply push": "apply_push",
    "print components": "print_components",
    "print tokens": "print_tokens",
    "import": "import",
}
# Definition types of server types; any other is a string.
SERVER_TYPES = {"string": "string", "text": "string", "richtext": "richtext", "media": "media", "link": "link", "enum": "enum", "symbol": "enum", "token": "token", "boolean": "boolean"}
# Types that a comparison holds equal; any other is itself in lower case.
COMPARED_TYPES = {"boolean": "boolean", "number": "number", "symbol": "symbol", "enum": "symbol", "string": "string", "text": "string", "richtext": "string", "media": "string"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))[key]


def normalize_command(command: str | Column) -> Column:
    """The tracked name of a command chain, null if it isn't tracked."""
    return _lookup(COMMANDS, F.col(command) if isinstance(command, str) else command)


def map_server_type(server_type: str | Column) -> Column:
    return F.coalesce(_lookup(SERVER_TYPES, F.lower(server_type)), F.lit("string"))


def compared_type(type_: str | Column) -> Column:
    return F.coalesce(_lookup(COMPARED_TYPES, F.lower(type_)), F.lower(type_))


def kebab_to_pascal(name: str | Column) -> Column:
    """Upper-case the first letter of each part between hyphens and join them; other letters stay."""
    parts = F.filter(F.split(name, "-"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def component_id(name: str | Column, source: str | Column) -> Column:
    """First 12 hex digits of the SHA-256 of name:source."""
    return F.substring(F.sha2(F.concat(name, F.lit(":"), source), 256), 1, 12)


def review_id(name: str | Column, source: str | Column) -> Column:
    return F.concat(name, F.lit("-"), component_id(name, source))


def prompt_hash(prompt: str | Column, agent: str | Column, model: str | Column) -> Column:
    """SHA-256 of prompt hash, agent and model, joined by vertical bars; null counts as empty."""
    return F.sha2(F.concat_ws("|", F.sha2(prompt, 256), F.coalesce(agent, F.lit("")), F.coalesce(model, F.lit(""))), 256)


def truncate_text(text: str | Column, most: int, mark: str = "\n/* truncated */") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(F.col(text) if isinstance(text, str) else text)


def snippet(text: str, token: str, around: int) -> Column:
    """Text within `around` characters of the token's first place, widened to whole lines; null where there is none."""
    body, at = F.col(text), F.locate(token, F.col(text))
    start = F.greatest(F.lit(1), at - around)
    before = body.substr(F.lit(1), start - 1)
    back = F.locate("\n", F.reverse(before))
    first = F.when(back > 0, start - back + 1).otherwise(1)
    stop = at + len(token) + around
    ahead = F.locate("\n", body.substr(stop, F.length(body)))
    last = F.when(ahead > 0, stop + ahead - 1).otherwise(F.length(body) + 1)
    return F.when(at > 0, body.substr(first, last - first))
