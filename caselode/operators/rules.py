"""Rule scan: a subset of the common rule language compiled to Column expressions.

A rule has strings (text with optional nocase, /regular expressions/, { hex }) and a condition made
of: any of them, all of them, N of them, $x, $x at N, and, or, not, parentheses. Anything else is
refused with the rule's name. Every rule is one expression in a single pass; no cross join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The built-in rules (name: strings, condition, category).
BUILTIN = r"""
rule Contains_Private_Key {
    meta: category = "credentials"
    strings:
        $a = "-----BEGIN RSA PRIVATE KEY-----"
        $b = "-----BEGIN PRIVATE KEY-----"
        $c = "-----BEGIN OPENSSH PRIVATE KEY-----"
        $d = "-----BEGIN EC PRIVATE KEY-----"
    condition: any of them
}
rule Contains_AWS_Key {
    meta: category = "credentials"
    strings: $a = /AKIA[0-9A-Z]{16}/
    condition: $a
}
rule Windows_PE_Executable {
    meta: category = "executable"
    strings: $mz = { 4D 5A }
    condition: $mz at 0 and uint32(uint32(0x3C)) == 0x00004550
}
rule ELF_Executable {
    meta: category = "executable"
    strings: $elf = { 7F 45 4C 46 }
    condition: $elf at 0
}
rule Bitcoin_Wallet_Strings {
    meta: category = "cryptocurrency"
    strings:
        $a = "wallet.dat" nocase
        $b = "bitcoin" nocase
        $c = "blockchain" nocase
    condition: 2 of them
}
rule Email_Credentials_Config {
    meta: category = "credentials"
    strings:
        $a = "smtp_password" nocase
        $b = "imap_password" nocase
        $c = "mail_password" nocase
    condition: any of them
}
rule Browser_Saved_Passwords {
    meta: category = "credentials"
    strings:
        $a = "Login Data" nocase
        $b = "moz_logins"
        $c = "encryptedUsername"
    condition: any of them
}
"""

_RULE = re.compile(r"rule\s+(\w+)\s*(?::[\w\s]+)?\{(.*?)\n\}", re.S)
_STRING = re.compile(r'(\$\w+)\s*=\s*("(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)+/|\{[0-9A-Fa-f\s?]+\})((?:\s+(?:nocase|ascii|wide))*)')
_TOKEN = re.compile(r"\s*(?:(any|all|\d+)\s+of\s+them|(\$\w+)\s+at\s+(\d+)|(\$\w+)|(and|or|not|\(|\))|(uint32\(uint32\(0x[0-9A-Fa-f]+\)\)\s*==\s*0x[0-9A-Fa-f]+|uint(?:16|32)\(\d+\)\s*==\s*0x[0-9A-Fa-f]+))")


@dataclass
class Rule:
    name: str
    strings: dict[str, tuple[str, bytes | str, bool]] = field(default_factory=dict)  # id -> kind, value, nocase
    condition: str = ""
    category: str = ""


def parse_rules(text: str) -> list[Rule]:
    out = []
    for name, body in _RULE.findall(text):
        rule = Rule(name)
        if m := re.search(r'category\s*=\s*"([^"]*)"', body):
            rule.category = m[1]
        strings, _, condition = body.partition("condition:")
        for ident, value, flags in _STRING.findall(strings.partition("strings:")[2]):
            if value[0] == '"':
                rule.strings[ident] = ("text", value[1:-1].replace('\\"', '"').replace("\\\\", "\\"), "nocase" in flags)
            elif value[0] == "/":
                rule.strings[ident] = ("regex", value[1:-1], "nocase" in flags)
            else:
                digits = re.sub(r"\s", "", value[1:-1])
                if "?" in digits or len(digits) % 2:
                    raise ValueError(f"rule {name}: hex wild cards are not supported")
                rule.strings[ident] = ("hex", bytes.fromhex(digits), False)
        rule.condition = " ".join(condition.split())
        if not rule.condition:
            raise ValueError(f"rule {name}: no condition")
        out.append(rule)
    if not out:
        raise ValueError("no rule")
    return out


def _hex(data: Column) -> Column:
    return F.hex(data)


def _found(rule: Rule, ident: str, data: Column, text: Column) -> Column:
    if ident not in rule.strings:
        raise ValueError(f"rule {rule.name}: unknown string {ident}")
    kind, value, nocase = rule.strings[ident]
    if kind == "hex":  # at byte boundaries of the hex text
        return _hex(data).rlike(f"^(?:..)*?{value.hex().upper()}")
    if kind == "regex":
        return text.rlike(("(?i)" if nocase else "") + value)
    return F.lower(text).contains(value.lower()) if nocase else text.contains(value)


def _at(rule: Rule, ident: str, offset: int, data: Column) -> Column:
    kind, value, _ = rule.strings[ident]
    if kind == "regex":
        raise ValueError(f"rule {rule.name}: regular expressions have no fixed place")
    raw = value if isinstance(value, bytes) else value.encode()
    return F.hex(F.substring(data, offset + 1, len(raw))) == raw.hex().upper()


def _uint(data: Column, at: Column, size: int) -> Column:
    """Little-endian number at a byte offset; NULL beyond the end."""
    h = F.hex(F.substring(data, at + 1, F.lit(size)))
    return F.when(F.length(h) == 2 * size, F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("bigint"))


def compile_rule(rule: Rule, data: Column) -> Column:
    """The condition as a boolean Column over BINARY ``data``; text strings are looked for byte by byte (Latin-1)."""
    text = F.decode(data, "ISO-8859-1")
    pos, tokens = 0, []
    while pos < len(rule.condition.rstrip()):
        m = _TOKEN.match(rule.condition, pos)
        if not m:
            raise ValueError(f"rule {rule.name}: can't read {rule.condition[pos:]!r}")
        tokens.append(m)
        pos = m.end()

    def atom(m: re.Match) -> Column:
        if m[1]:
            n = {"any": 1, "all": len(rule.strings)}.get(m[1]) or int(m[1])
            return sum((F.when(_found(rule, s, data, text), 1).otherwise(0) for s in rule.strings), F.lit(0)) >= n
        if m[2]:
            return _at(rule, m[2], int(m[3]), data)
        if m[4]:
            return _found(rule, m[4], data, text)
        inner, _, want = m[6].partition("==")
        at, value = int(re.search(r"\(?(0x[0-9A-Fa-f]+|\d+)\)", inner)[1], 0), int(want.strip(), 0)
        if inner.startswith("uint32(uint32("):
            return _uint(data, _uint(data, F.lit(at), 4).cast("int"), 4) == value
        return _uint(data, F.lit(at), 2 if inner.startswith("uint16") else 4) == value

    i = 0

    def either() -> Column:
        nonlocal i
        out = both()
        while i < len(tokens) and tokens[i][5] == "or":
            i += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal i
        out = one()
        while i < len(tokens) and tokens[i][5] == "and":
            i += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal i
        if i >= len(tokens):
            raise ValueError(f"rule {rule.name}: the condition breaks off")
        m = tokens[i]
        i += 1
        if m[5] == "not":
            return ~one()
        if m[5] == "(":
            out = either()
            if i >= len(tokens) or tokens[i][5] != ")":
                raise ValueError(f"rule {rule.name}: missing )")
            i += 1
            return out
        if m[5]:
            raise ValueError(f"rule {rule.name}: unexpected {m[5]}")
        return atom(m)

    out = either()
    if i != len(tokens):
        raise ValueError(f"rule {rule.name}: can't read the end of its condition")
    return F.coalesce(out, F.lit(False))


def rule_matches(df: DataFrame, data: str, *keep: str, rules: str = BUILTIN) -> DataFrame:
    """``keep`` columns, rule and category for every rule that a row's bytes (BINARY or STRING) satisfy. NULL matches nothing."""
    parsed = parse_rules(rules)
    raw = F.coalesce(F.col(f"`{data}`").cast("binary"), F.lit(b""))
    hits = F.array_compact(F.array(*[F.when(compile_rule(r, raw), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"))) for r in parsed]))
    return df.select(*keep, F.explode(hits).alias("m")).select(*keep, "m.rule", "m.category")


def rule_counts(matches: DataFrame, source: str) -> DataFrame:
    """Hits by rule and source."""
    return matches.groupBy("rule", source).agg(F.count(F.lit(1)).alias("count"))
