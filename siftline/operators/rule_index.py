"""Rules as data: entries, the keys that lead to them, and how a row looks them up.

A rule is one or more entries: a list of event types and of tests that must all hold.
An entry stands under literal keys (an event id, a file name, a stem, an extension, a
host suffix) or, where its rule has none, in a group whose one combined pattern decides
whether the group is looked at, and then a literal of each entry's pattern whether it is. The whole is one row: `buckets` (keys by their checksum),
`groups`, `entries` and `rules`. Spark folds each of these into one constant that goes to
every task, so the query's plan has the same nodes however many rules there are, rows
are not multiplied or shuffled, and a row costs a look-up per key. The size is checked.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a rule set that go to every task; entries under a key from which on a
#: combined pattern is asked first.
MOST_CHARS, CROWDED = 64 << 20, 8

NO_ENTRIES = "cast(array() as array<int>)"
TEST = "struct<fields:array<int>,names:array<string>,op:string,texts:array<struct<text:string,literal:string>>>"
KINDS = {
    "buckets": "array<array<struct<key:string,entries:array<int>,gate:string,gated:array<int>>>>", "groups": "array<array<struct<literal:string,entries:array<int>>>>",
    "entries": f"array<struct<rule:int,types:array<string>,tests:array<{TEST}>>>",
    "rules": "array<struct<rule_id:string,plugin:string,analysis_type:string,score:string,justification:string,mitre:array<string>,tool:string>>",
}


def literal_of(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds, in
    lower case; '' where none is sure."""
    runs, run, depth, i = [], "", 0, 0
    text = re.sub(r"^\(\?i\)", "", pattern)
    if re.search(r"\\[QE]|\(\?[a-z]", text):
        return ""
    while i < len(text):
        c, size = text[i], 1
        if c == "\\":
            c, size = text[i + 1: i + 2], 2
            # Escaped letters and digits are classes, borders or references.
            plain = c if c and not c.isalnum() else None
        elif c == "[":
            inner = re.match(r"\[\^?\]?(?:\\.|[^\]\\\[])*\]", text[i:])
            if not inner:
                return ""
            size, plain = inner.end(), None
        elif c in "(" ")":
            depth, plain = depth + (1 if c == "(" else -1), None
        elif c == "|" and depth == 0:
            return ""
        else:
            plain = None if c in "^$.|?*+{}" or not c.isascii() else c
        follows = text[i + size: i + size + 1]
        if c == "{" and size == 1:
            size = max(text.find("}", i) - i + 1, 1)
        if plain is not None and depth == 0 and follows not in ("?", "*", "{"):
            run += plain
        if plain is None or depth or follows in ("?", "*", "{", "+"):
            runs.append(run)
            run = ""
        i += size
    return max([*runs, run], key=len).lower()


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words and shares their beginnings, so that a
    character is compared with the different ones that may stand there, not with each
    word."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            out += re.escape(c)
        # A word that ends here is enough, whatever could follow.
        if not node or "" in node:
            return out
        return f"{out}(?:{'|'.join(re.escape(c) + spelled(n) for c, n in sorted(node.items()))})"

    return spelled(trie)


def combined(patterns: list[str]) -> str:
    """One pattern that is found at least wherever one of them is: their literals, and
    the patterns of which none is sure. Groups are renumbered by the union, so one that
    refers back to a group counts as found anywhere."""
    literals = {p: literal_of(p) for p in dict.fromkeys(patterns)}
    words = sorted({w for w in literals.values() if len(w) > 2})
    rest = [p for p, w in literals.items() if len(w) <= 2]
    own = [p for p in rest if not re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]", p)]
    return "|".join([*(["(?i:" + any_word(words) + ")"] if words else []), *(f"(?:{p})" for p in own), *([""] if len(own) < len(rest) else [])])


class Index:
    """Collects rules in the order in which their hits are listed."""

    def __init__(self, facets: list[str]):
        self.facets = {name: i for i, name in enumerate(facets)}
        self.rules: list[dict] = []
        self.entries: list[dict] = []
        self.keys: dict[str, list[int]] = defaultdict(list)
        #: Per group: literal that an entry's pattern needs ('' where none is sure) -> entries.
        self.groups: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.patterns: dict[str, list[str]] = defaultdict(list)
        self._parts: dict[str, Column] | None = None

    def rule(self, rule: dict, plugin: str, tool: str | None = "") -> int:
        """`tool` None means the event's own program or file name."""
        self.rules.append({
            "rule_id": rule["rule_id"], "plugin": plugin, "analysis_type": rule.get("analysis_type", ""), "score": rule.get("score", ""),
            "justification": rule.get("justification", ""), "mitre": list(rule.get("mitre", [])), "tool": tool,
        })
        return len(self.rules) - 1

    def test(self, fields: list[str], op: str, texts: list[str], names: list[str] | None = None) -> dict:
        """Any of the facets (or the first filled attribute of `names`) holds any of
        the texts: `find` a pattern, `in` equal, `contains`."""
        return {"fields": [self.facets[f] for f in fields], "names": list(names or []), "op": op, "texts": [
            {"text": t, "literal": literal_of(t) if op == "find" else ""} for t in texts]}

    def entry(self, rule: int, tests: list[dict], keys: list[str] = (), group: str | None = None, patterns: list[str] = (),
              types: list[str] = ()) -> None:
        self.entries.append({"rule": rule, "types": list(types), "tests": tests})
        for key in dict.fromkeys(keys):
            self.keys[key].append(len(self.entries) - 1)
        if group is not None:
            for literal in dict.fromkeys(map(literal_of, patterns)):
                self.groups[group][literal].append(len(self.entries) - 1)
            self.patterns[group] += patterns

    def pattern(self, group: str) -> str | None:
        """The combined pattern of a group, None without such entries."""
        return combined(self.patterns[group]) if self.groups.get(group) else None

    def used(self) -> set[str]:
        """Facets that a test looks at."""
        asked = {i for e in self.entries for t in e["tests"] for i in t["fields"]}
        return {name for name, i in self.facets.items() if i in asked}

    def kinds(self) -> set[str]:
        return {key.partition(":")[0] for key in self.keys}

    def part(self, name: str) -> Column:
        """`buckets`, `groups`, `entries` or `rules` as a constant."""
        if self._parts is None:
            buckets: list[list] = [[] for _ in range(1 << max(4, (2 * len(self.keys)).bit_length()))]
            for key, numbers in self.keys.items():
                buckets[zlib.crc32(key.encode()) % len(buckets)].append({"key": key} | self._under(numbers))
            self.slots, self.order = len(buckets), list(self.groups)
            texts = {k: json.dumps(v) for k, v in {
                "buckets": buckets, "groups": [[{"literal": w, "entries": n} for w, n in self.groups[g].items()] for g in self.order], "entries": self.entries, "rules": self.rules}.items()}
            size = sum(map(len, texts.values()))
            if size > MOST_CHARS:
                raise ValueError(f"a rule set of {size} characters is too large to go to every task")
            self._parts = {k: F.from_json(F.lit(t), KINDS[k]) for k, t in texts.items()}
        return self._parts[name]

    def _under(self, numbers: list[int]) -> dict:
        """The entries of one key. Of many, those that look for a literal in an
        attribute wait for a pattern that finds any of these literals."""

        def literal(number: int) -> str:
            tests = [t for t in self.entries[number]["tests"] if t["names"] and len(t["texts"]) == 1]
            return max((t["texts"][0]["literal"] for t in tests), key=len, default="")

        words = {i: w for i in numbers if len(w := literal(i)) > 2}
        if len(words) < CROWDED:
            return {"entries": numbers, "gate": "", "gated": []}
        return {"entries": [i for i in numbers if i not in words], "gate": f"(?i:{any_word(sorted(set(words.values())))})", "gated": list(words)}

    def under(self, keys: Column, attrs: Column) -> Column:
        """Numbers of the entries under any of a row's keys."""
        buckets = self.part("buckets")

        def entries(e: Column) -> Column:
            held = F.rlike(F.concat_ws("\n", F.map_values(attrs)), e["gate"])
            return F.when((e["gate"] != "") & held, F.concat(e["entries"], e["gated"])).otherwise(e["entries"])

        def look_up(key: Column) -> Column:
            bucket = F.get(buckets, F.pmod(F.crc32(key.cast("binary")), F.lit(self.slots)).cast("int"))
            return F.flatten(F.transform(F.filter(bucket, lambda e: e["key"] == key), entries))

        return F.flatten(F.transform(keys, look_up))

    def of_group(self, group: str, gate: Column, *fields: Column) -> Column:
        """Numbers of the group's entries whose literal one of the fields holds, where
        the gate, the group's combined pattern, lets the row in."""
        listed = F.get(self.part("groups"), F.lit(self.order.index(group)))

        def held(text: Column) -> Column:
            return F.flatten(F.transform(F.filter(listed, lambda g: F.contains(text, g["literal"])), lambda g: g["entries"]))

        # As a list of one, the text is put together once for all literals.
        found = F.flatten(F.transform(F.array(F.lower(F.concat_ws("\n", *fields))), held))
        return F.when(F.coalesce(gate, F.lit(False)), found).otherwise(F.expr(NO_ENTRIES))

    def holding(self, numbers: Column, facets: Column, event_type: Column, attrs: Column) -> Column:
        """Numbers of the rules, in order, of which an entry's tests all hold."""
        entries = self.part("entries")

        def holds(t: Column) -> Column:
            named = F.filter(F.transform(t["names"], lambda n: attrs[n]), lambda v: v != "")
            values = F.concat(F.transform(t["fields"], lambda i: F.get(facets, i)), F.slice(named, 1, 1))
            # Here a pattern is compiled each time it is asked; its literal mostly decides.
            return F.exists(values, lambda v: F.coalesce(F.exists(t["texts"], lambda p: (
                F.when(t["op"] == "find", F.contains(F.lower(v), p["literal"]) & F.rlike(v, p["text"]))
                .when(t["op"] == "in", v == p["text"])
                .otherwise(v.contains(p["text"])))), F.lit(False)))

        def true(number: Column) -> Column:
            e = F.get(entries, number)
            of_type = (F.size(e["types"]) == 0) | F.array_contains(e["types"], event_type)
            return F.coalesce(of_type, F.lit(False)) & F.forall(e["tests"], holds)

        return F.array_sort(F.array_distinct(F.transform(F.filter(F.array_distinct(numbers), true), lambda i: F.get(entries, i)["rule"])))
