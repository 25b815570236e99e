"""Language packs: what the extractor looks for in each language.

No parser library is at hand, so packs describe declarations by patterns over text in which comments and strings
are blanked out, and find extents by braces, `end` words or indentation. `fidelity` says how close that comes to
a grammar: close (a real parser, or a full scanner of a simple format) or heuristic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Where a member may begin.
HEAD = r"(?m)(?:^|(?<=[{;}]))[ \t]*"

ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*+"

C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
HASH_COMMENT = r"#[^\n]*"
QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
DOUBLE = r'"(?:\\.|[^"\\\n])*"?'

# Words that no declaration or call is named by: everywhere, and in one language.
CONTROL = frozenset("if for while switch return do else case".split())
KEYWORDS = {lang: CONTROL | frozenset(words.split()) for lang, words in {
    "go": "func go defer range select", "java": "catch new throw synchronized super this assert", "c": "sizeof typeof goto", "cuda": "sizeof typeof goto",
    "cpp": "sizeof typeof goto catch new delete throw alignof decltype static_assert noexcept", "csharp": "catch new throw foreach using lock fixed typeof nameof base this",
    "dart": "catch new throw await assert super this", "elixir": "fn cond unless def defp defmodule", "bash": "then fi done esac function local",
    "javascript": "catch new throw typeof await yield function super of in", "typescript": "catch new throw typeof await yield function super of in",
    "tsx": "catch new throw typeof await yield function super of in", "kotlin": "when catch throw fun super this", "lua": "function end local and or not then",
    "objc": "sizeof typeof goto", "php": "catch new throw echo print isset unset empty array list exit die include require foreach function fn match",
    "ruby": "def end unless until elsif and or not super yield", "rust": "fn match loop", "swift": "func guard catch throw super"}.items()}


@dataclass(frozen=True)
class Rule:
    """A declaration: its kind, its kind inside a type, a pattern with group `name`, and where it ends."""

    kind: str
    pattern: str
    end: str = "brace"  # brace: at its block or the statement's end; line; match
    member: str | None = None  # kind inside a type; "" drops it there
    free: bool = True  # found outside types
    raw: bool = False  # looked for in the text as it is, strings included; it must not begin inside one
    gated: bool = False  # only between #if and #endif, outside all braces


@dataclass(frozen=True)
class Pack:
    blank: str  # comments and strings
    rules: tuple[Rule, ...] = ()
    refs: tuple[str, ...] = ()  # patterns with group `name`
    decisions: str = r"\b(?:if|for|while|case)\b"
    blocks: str = "brace"  # brace or end
    opens: str = ""  # words that open an `end` block
    fidelity: str = "heuristic"


CALL = rf"(?P<name>{ID})\s*\("
NEW = rf"\bnew\s+(?:{ID}\s*\.\s*)*(?P<name>{ID})"
N = rf"(?P<name>{ID})"
C_DECISIONS = r"\b(?:if|for|while|do|case)\b|\?(?=[^?:]*:)"
JS_DECISIONS = r"\b(?:if|for|while|do|catch)\b|\?(?![.?])(?=[^?]*:)"
MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|readonly|partial|extern|new|unsafe|synchronized|native|default|open|data|inline|suspend|operator|lateinit|const|export|declare|fileprivate|mutating|nonisolated|required|convenience|external|factory|get|set|tailrec|infix|inner|annotation|enum|value|actual|expect|strictfp|transient|volatile)\s+)*"
TYPE = rf"[A-Za-z_][\w.<>,?\[\]&*:~ ]*?[\w>\]?&*]"

_JS = (
    Rule("fn", rf"(?m)\b(?:async\s+)?function\s*\*?\s*{N}\s*[<(]"),
    Rule("cls", rf"\bclass\s+{N}\b"),
    Rule("method", rf"{HEAD}{MODIFIERS}\*?(?P<name>#?{ID})\s*(?:<[^>\n]*>)?\([^;{{}}]*?\)\s*(?::[^{{;\n]+)?\{{", member="method", free=False),
    Rule("method", rf"{HEAD}{MODIFIERS}(?P<name>#?{ID})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{ID})\s*(?::[^=\n]+)?=>", member="method", free=False),
    Rule("fn", rf"(?m)\b(?:const|let|var)\s+{N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{ID})\s*(?::[^=\n]+)?=>"),
    Rule("fn", rf"(?m)\b(?:const|let|var)\s+{N}\s*=\s*(?:async\s+)?function\b"),
    Rule("var", rf"(?m)^(?:export\s+)?(?:const|var)\s+{N}\s*(?::[^=\n]+)?=", end="line"),
)
_TS = _JS + (
    Rule("cls", rf"(?m)^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{N}"),
    Rule("iface", rf"\binterface\s+{N}"),
    Rule("cls", rf"(?m)^\s*(?:export\s+)?(?:declare\s+)?type\s+{N}[^=\n]*=", end="line"),
    Rule("method", rf"{HEAD}{MODIFIERS}{N}\??\s*(?:<[^>\n]*>)?\([^;{{}}]*?\)\s*:[^{{;\n]+;", end="match", member="method", free=False),
)
_C = (
    Rule("cls", rf"(?m)\b(?:struct|union)\s+{N}\s*(?=\{{)"),
    Rule("cls", rf"(?m)\benum\s+(?:class\s+)?{N}\s*(?::[^{{;]*)?(?=\{{)"),
    Rule("cls", rf"(?m)^\s*typedef\b[^;{{]*?(?:\{{[^{{}}]*\}}\s*)?{N}\s*;", end="match"),
    Rule("fn", rf"(?m)^(?!\s*(?:return|else|typedef|if|while|for|switch)\b)[A-Za-z_][\w \t*&:<>,]*?[ \t*&]{N}\s*\([^;{{}}]*\)\s*(?=[{{;])", member="method"),
    Rule("macro", rf"(?m)^[ \t]*#[ \t]*define[ \t]+{N}", end="line"),
    Rule("var", rf"(?m)^(?:static\s+|extern\s+|const\s+)*[A-Za-z_][\w \t*]*?[ \t*]{N}\s*(?:\[[^\]]*\]\s*)*=(?!=)", end="line"),
    Rule("var", rf"{HEAD}(?!return\b|goto\b|typedef\b)[A-Za-z_][\w:<>, \t*&]*?[ \t*&]{N}\s*(?:\[[^\]]*\]\s*)*;", end="line", member="var", free=False),
)
_JVM_CALLS = (CALL, NEW)

PACKS: dict[str, Pack] = {
    "go": Pack(
        C_COMMENT + "|`[^`]*`?|" + QUOTED,
        (
            Rule("fn", rf"(?m)^func\s+{N}\s*[(\[]"),
            Rule("method", rf"(?m)^func\s*\([^)]*\)\s*{N}\s*[(\[]"),
            Rule("struct", rf"(?m)^\s*(?:type\s+)?{N}(?:\[[^\]]*\])?\s+struct\b"),
            Rule("iface", rf"(?m)^\s*(?:type\s+)?{N}(?:\[[^\]]*\])?\s+interface\b"),
            Rule("cls", rf"(?m)^\s*type\s+{N}\s*+=?\s*+(?!struct\b|interface\b)[\w*\[(]", end="line"),
            Rule("var", rf"(?m)^\s*(?:var|const)\s+{N}", end="line"),
            Rule("method", rf"{HEAD}{N}\([^)\n]*\)[^{{\n]*$", end="match", member="method", free=False),
        ),
        (CALL,), r"\b(?:if|for|case)\b"),
    "java": Pack(
        C_COMMENT + '|""".*?"""|' + QUOTED,
        (
            Rule("cls", rf"{MODIFIERS}\b(?:class|enum|record)\s+{N}"),
            Rule("iface", rf"{MODIFIERS}@?\binterface\s+{N}"),
            Rule("method", rf"{HEAD}{MODIFIERS}(?:<[^>\n]*>\s*)?{TYPE}\s+{N}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?(?=[{{;])", member="method", free=False),
            Rule("method", rf"{HEAD}{MODIFIERS}{N}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?(?=\{{)", member="method", free=False),
            Rule("var", rf"{HEAD}{MODIFIERS}{TYPE}\s+(?P<name>[A-Z0-9_]*[A-Z][A-Z0-9_]*)\s*[=;]", end="line", member="var", free=False),
        ),
        (*_JVM_CALLS, rf"(?m)^\s*import\s+(?:static\s+)?(?:{ID}\.)*(?P<name>{ID})\s*;"),
        r"\b(?:if|while|do|catch|switch)\b|\bfor\s*\((?![^;)]*:)|\?(?=[^?:>]*:)"),
    "c": Pack(C_COMMENT + "|" + QUOTED, _C, (CALL,), C_DECISIONS),
    "cpp": Pack(
        C_COMMENT + "|" + QUOTED,
        (
            Rule("cls", rf"\b(?:class|struct|union)\s+(?:{ID}::)*{N}\s*(?:final\s*)?(?::[^{{;]*)?(?=\{{)"),
            Rule("method", rf"(?m)^[A-Za-z_][\w \t*&:<>,]*?[ \t*&](?:{ID}::)+(?P<name>~?{ID}|operator\s*[^\s(]+)\s*\([^;{{}}]*\)[^;{{}}]*(?=\{{)"),
            Rule("method", rf"{HEAD}(?!return\b|else\b|delete\b|throw\b|new\b)(?:[A-Za-z_][\w \t*&:<>,]*?[ \t*&])?(?P<name>~?{ID})\s*\([^;{{}}]*\)[^;{{}}()=]*(?=[{{;])", member="method", free=False),
            Rule("method", rf"(?P<name>operator\s*[^\s\w(]+)\s*\([^;{{}}]*\)[^;{{}}]*(?=[{{;])"),
            *_C[1:],
            # A call followed by a block: what a test macro looks like before it is expanded.
            Rule("macro", rf"(?m)^[ \t]*{N}[ \t]*\([^;{{}}()]*(?:\([^;{{}}()]*\)[^;{{}}()]*)*\)\s*(?=\{{)"),
            Rule("var", rf"(?m)^[ \t]*(?!return\b|goto\b|typedef\b|using\b|struct\b|class\b|enum\b)[A-Za-z_][\w:<>, \t*&]*?[ \t*&]{N}\s*(?:\[[^\]]*\]\s*)*;", end="line", gated=True),
        ),
        (CALL, rf"(?P<name>{ID})\s*<[^<>;(){{}}]*>\s*\(", rf"\busing\s+(?:namespace\s+)?(?:{ID}::)*(?P<name>{ID})\s*;"),
        C_DECISIONS + r"|\bcatch\b"),
    "csharp": Pack(
        C_COMMENT + "|" + '@"(?:""|[^"])*"?|' + QUOTED,
        (
            Rule("cls", rf"{MODIFIERS}\b(?:class|record|enum)\s+{N}"),
            Rule("struct", rf"{MODIFIERS}\bstruct\s+{N}"),
            Rule("iface", rf"{MODIFIERS}\binterface\s+{N}"),
            Rule("method", rf"{HEAD}{MODIFIERS}{TYPE}\s+{N}\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?:where[^{{;]*)?(?=[{{;]|=>)", member="method", free=False),
            Rule("method", rf"{HEAD}{MODIFIERS}{N}\s*\([^;{{}}]*\)\s*(?::[^{{;]*)?(?=\{{)", member="method", free=False),
            Rule("var", rf"{HEAD}{MODIFIERS}{TYPE}\s+{N}\s*(?=\{{\s*(?:get|set|init)\b|=>|=|;)", member="var", free=False),
        ),
        (CALL, rf"(?P<name>{ID})\s*<[^<>;(){{}}]*>\s*\(", NEW),
        r"\b(?:if|while|do|catch)\b|\bfor\s*\(|\?(?![.?])(?=[^?:;]*:)|=>(?=[^;{}]*,)|\bswitch\s*\{"),
    "dart": Pack(
        C_COMMENT + "|" + QUOTED,
        (
            Rule("cls", rf"(?m)^\s*(?:abstract\s+)?(?:class|mixin|extension|enum)\s+{N}"),
            Rule("cls", rf"(?m)^\s*typedef\s+{N}", end="line"),
            Rule("method", rf"{HEAD}{MODIFIERS}(?:(?!(?:class|mixin|extension|enum)\b){TYPE}\s+)?(?:get\s+|set\s+)?{N}\s*(?:\([^;{{}}]*\))?\s*(?:async\*?\s*)?(?=\{{|=>)", member="method", free=False),
            Rule("fn", rf"(?m)^{TYPE}\s+{N}\s*\([^;{{}}]*\)\s*(?:async\*?\s*)?(?=\{{|=>)", member="method"),
        ),
        (CALL,), C_DECISIONS + r"|\bcatch\b"),
    "elixir": Pack(
        HASH_COMMENT + '|""".*?"""|' + DOUBLE,
        (
            Rule("cls", r"(?m)^\s*(?:defmodule|defprotocol|defimpl|alias|import|use|require)\s+(?P<name>[A-Z][\w.]*)", end="end"),
            Rule("fn", r"(?m)^\s*(?:defp?|defmacrop?|defguardp?|defdelegate)\s+(?P<name>[a-z_]\w*[?!]?)", end="end"),
            Rule("fn", r'(?m)^[ \t]*[a-z_]\w*[?!]?[ \t(]+(?P<name>"(?:\\.|[^"\\\n])*")[^\n]*?\bdo\b(?!:)', end="end", raw=True),
        ),
        (r"(?P<name>[a-z_]\w*[?!]?)\(", r"\|>\s*(?:[\w.]+\.)?(?P<name>[a-z_]\w*[?!]?)"), r"(?!)", "end", r"\b(?:do|fn)\b(?!:)"),
    "bash": Pack(
        r"(?<![\w$])#[^\n]*|" + QUOTED,
        (Rule("fn", r"(?m)^\s*(?:function\s+)?(?P<name>[\w.-]+)\s*\(\)\s*(?=[{(])"), Rule("fn", r"(?m)^\s*function\s+(?P<name>[\w.-]+)\s*(?=\{)")),
        (r"(?m)(?:^|[;&|]|\$\(|\bthen|\bdo|\belse)[ \t]*(?P<name>[A-Za-z_][\w.-]*)(?=[\s;|&)]|$)(?!\s*\(\))",), r"\b(?:if|for|while)\b"),
    "javascript": Pack(C_COMMENT + "|`(?:\\\\.|[^`\\\\])*`?|" + QUOTED, _JS + (
        Rule("method", rf"(?m)^\s*(?:(?:{ID}|\]|\))\.)+?{ID}\.{N}\s*=\s*(?:async\s*)?(?:function\s*\*?\s*\(|(?:\([^()]*\)|{ID})\s*=>)"),
        Rule("fn", rf"(?<=[{{,])\s*{N}\s*:\s*(?:async\s*)?(?:function\b|(?:\([^()]*\)|{ID})\s*=>)"),), (CALL, NEW), JS_DECISIONS),
    "typescript": Pack(C_COMMENT + "|`(?:\\\\.|[^`\\\\])*`?|" + QUOTED, _TS, (CALL, NEW), JS_DECISIONS),
    "kotlin": Pack(
        C_COMMENT + '|""".*?"""|' + QUOTED,
        (
            Rule("cls", rf"{MODIFIERS}\b(?:class|interface|object)\s+{N}"),
            Rule("fn", rf"(?m){MODIFIERS}\bfun\s+(?:<[^>\n]*>\s*)?(?:[\w.<>?]+\.)?{N}\s*\("),
        ),
        (CALL, rf"(?m)^\s*import\s+(?:{ID}\.)*(?P<name>{ID})"), r"\b(?:if|for|while|do|catch)\b"),
    "lua": Pack(
        r"--\[\[.*?\]\]|--[^\n]*|" + QUOTED,
        (
            Rule("method", rf"\bfunction\s+(?:{ID}\.)*{ID}:{N}\s*\(", end="end"),
            Rule("fn", rf"\bfunction\s+(?:{ID}\.)*{N}\s*\(", end="end"),
            Rule("fn", rf"(?m)^\s*(?:local\s+)?(?:{ID}\.)*{N}\s*=\s*function\b", end="end"),
        ),
        (CALL, rf"(?P<name>{ID})\s*[\"'{{]"), r"\b(?:if|for|while)\b", "end", r"\b(?:function|if|for|while|do(?!\w))\b"),
    "objc": Pack(
        C_COMMENT + "|@?" + QUOTED,
        (
            Rule("cls", rf"(?m)^@(?:interface|implementation)\s+{N}", end="end"),
            Rule("iface", rf"(?m)^@protocol\s+{N}(?![^\n]*;)", end="end"),
            Rule("method", rf"(?m)^[-+]\s*\([^)]*\)\s*{N}[^;{{]*(?=[{{;])"),
            _C[3],
        ),
        (rf"\[\s*[\w\]\[ .()]+?\s+{N}\s*[\]:]", CALL), C_DECISIONS, opens=r"^@(?:interface|implementation|protocol)\b"),
    "php": Pack(
        C_COMMENT + r"|#(?!\[)[^\n]*|" + QUOTED,
        (
            Rule("cls", rf"(?m)^\s*{MODIFIERS}(?:class|enum)\s+{N}"),
            Rule("iface", rf"(?m)^\s*(?:interface|trait)\s+{N}"),
            Rule("fn", rf"\bfunction\s+&?{N}\s*\(", member="method"),
            Rule("var", rf"(?m)\bconst\s+(?:\w+\s+)?{N}\s*=", end="line"),
            Rule("var", rf"(?m)^\s*case\s+{N}\s*[=;]", end="line", member="var", free=False),
        ),
        (CALL, rf"\bnew\s+\\?(?:{ID}\\)*(?P<name>{ID})"), C_DECISIONS + r"|\bcatch\b"),
    "ruby": Pack(
        HASH_COMMENT + r"|^=begin.*?^=end|" + QUOTED,
        (
            Rule("cls", r"(?m)^\s*(?:class|module)\s+(?:[A-Z]\w*::)*(?P<name>[A-Z]\w*)", end="end"),
            Rule("method", r"(?m)^\s*def\s+(?:self\.|\w+\.)?(?P<name>[A-Za-z_]\w*[?!=]?)", end="end"),
            Rule("var", r"(?m)^\s*(?P<name>[A-Z]\w*)\s*=(?!=|~)", end="line"),
        ),
        (r"(?P<name>[a-z_]\w*[?!]?)\(", r"\.(?P<name>[a-z_]\w*[?!]?)"), r"(?!)", "end",
        r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b|=\s*(?:if|case|begin)\b"),
    "rust": Pack(
        C_COMMENT + r'|r#*".*?"#*|' + DOUBLE + r"|'(?:\\.|[^'\\\n])'",
        (
            Rule("cls", rf"\b(?:struct|enum|union|mod|type)\s+{N}"),
            Rule("iface", rf"\btrait\s+{N}"),
            Rule("fn", rf"\bfn\s+{N}\s*[<(]", member="method"),
            Rule("macro", rf"\bmacro_rules!\s*{N}"),
            Rule("var", rf"\b(?:const|static)\s+(?:mut\s+)?{N}\s*:", end="line"),
        ),
        (CALL, rf"(?P<name>{ID})\s*::\s*<[^<>;]*>\s*\(", rf"(?P<name>{ID})!\s*[\(\[{{]"), r"\b(?:if|while)\b"),
    "swift": Pack(
        C_COMMENT + '|""".*?"""|' + DOUBLE,
        (
            Rule("cls", rf"{MODIFIERS}\b(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b|let\b){N}"),
            Rule("iface", rf"\bprotocol\s+{N}"),
            Rule("fn", rf"\bfunc\s+(?P<name>{ID}|[^\s\w(]+)\s*[<(]"),
            Rule("method", HEAD + r"(?:\w+\s+)*(?P<name>init|deinit|subscript)\b[?!]?\s*(?=[({<])", member="method", free=False),
            Rule("var", rf"(?m)^[ \t]*{MODIFIERS}(?:var|let)\s+{N}", end="line"),
            Rule("var", rf"(?m)^\s*case\s+{N}(?=\s*[(,=\n])", end="line", member="var", free=False),
            Rule("cls", rf"\b(?:typealias|associatedtype)\s+{N}", end="line"),
        ),
        (CALL,), r"\b(?:if|for|while|catch)\b|\?(?=[^?:.]*:)"),
}
PACKS["cuda"] = PACKS["c"]
PACKS["tsx"] = PACKS["typescript"]

# Languages with scanners of their own, and what those are worth.
SCANNED = {"python": "close", "json": "close", "toml": "close", "yaml": "heuristic", "html": "close"}


def fidelity(lang: str) -> str:
    return SCANNED.get(lang) or PACKS[lang].fidelity


compiled: dict[str, tuple] = {}


def compile_pack(lang: str) -> tuple:
    """(pack, blank, rules, refs, decisions), compiled once a worker."""
    if lang not in compiled:
        p = PACKS[lang]
        flags = re.S | re.M
        compiled[lang] = (
            p, re.compile(p.blank, flags), [(r, re.compile(r.pattern)) for r in p.rules], [re.compile(r) for r in p.refs],
            re.compile(p.decisions, flags))
    return compiled[lang]
