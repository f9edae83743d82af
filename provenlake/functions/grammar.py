"""Claim and command grammar as column expressions.

Everything here is a ``Column`` in, ``Column`` out: patterns run in java.util.regex
inside whole-stage code, none in Python.  ``(?U)`` makes classes and word
boundaries Unicode-aware, ``(?d)`` lets only a newline end a line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("test", "build", "push", "commit", "publish", "deploy", "write")
HINTS = ("wheel", "tsc", "cargo", "docker")

# --- Fixed values -----------------------------------------------------------
# The vocabulary of the claim and command grammar; results depend on exactly these.
CLAIM = {
    "test": r"\b(?:tests?|test suite|pytest|unit tests?)\b[^.!\n]{0,40}?\b(?:pass(?:ed|ing|es)?|green|succeed(?:ed|s)?)\b"
    r"|\ball (?:\d+ )?tests? green\b|\b\d+(?:/\d+)? tests? (?:pass(?:ed)?|green)\b|\b\d+ passed\b"
    r"|\b\d+\s*/\s*\d+\s+(?:(?:tests?|checks?|specs?|cases?|suites?)\s+)?(?:pass(?:ed|es|ing)?|green)\b"
    r"|\b\d+\s+(?:new\s+|unit\s+|forced-race\s+)?(?:tests?\s+)?pass(?:ed|es|ing)?\b"
    r"|\ball\s+\d+\s+(?:tests?\s+)?(?:pass(?:ed|es|ing)?|green)\b|\bgreen\b\W{0,6}\d+\s*/\s*\d+\b"
    r"|\b(?:CI|CI checks?|GitHub checks?|workflows?|pipeline|selftest|self-test|test run)\b[^.!\n]{0,30}?\b(?:green|pass(?:ed|es|ing)?|succeed(?:ed|s)?)\b"
    r"|\b(?:everything|everything's|all checks?|all of it|it all)\b[^.!\n]{0,24}\b(?:green|clean|pass(?:ed|es|ing)?|good)\b"
    r"|\bno (?:test |new )?failures\b|\b0 failed\b|\ball green\b|\bsuite is (?:green|clean|happy)\b|\bsuite pass(?:es|ed)\b"
    r"|\bverified\b[^.!\n]{0,40}?\b(?:with|by|via|using|against)\b[^.!\n]{0,30}?\btests?\b"
    r"|\b(?:quality\s+)?gates?\b\W{0,3}(?:is\s+|are\s+|all\s+)?green\b|\ball\s+(?:exit\s+codes?|rc)\s*(?:=|are|were)?\s*0\b",
    "build": r"\bbuilds? (?:succeed(?:ed|s)?|pass(?:ed|es|ing)?|(?:is |are )?green|work(?:s|ed))\b|\bcompil(?:es|ed) (?:cleanly|successfully|fine)\b"
    r"|\bbuilds?\b\W{0,3}(?:is\s+|was\s+|are\s+|were\s+)?(?:success(?:ful)?|finished|clean|ok|complete)\b"
    r"|\b(?:wheel|release|image|binary|binaries|artifact)s?\s+(?:built|builds)\b|\btsc\b[^.!\n]{0,15}\bclean\b|\bgood build\b|\b\d+ crates? compiled\b",
    "push": r"(?<![-\w])(?:force-)?pushed\b(?!\s+(?:me|you|us|him|her|them|back|hard|through|past|for|it off|the (?:limits?|envelope|edge)))"
    r"|\bpush(?:\s+to\s+\S+)?\s+succeeded\b|\bis (?:the )?remote HEAD\b",
    "commit": r"\bcommitted\b[^.!\n]{0,15}?`?\b[0-9a-f]{7,40}\b`?|(?:^|[(:—]\s*)\**commit\s+`?[0-9a-f]{7,40}\b`?"
    r"|(?<![-\w])committed\b(?! to (?:memory|the plan|helping|execut|writing|pay))",
    "publish": r"\bpublished\b(?=[^.!\n]*\b(?:npm|pypi|pip|crates|registry|package|marketplace|store|extension|gem|maven|release|live|search)\b)"
    r"|\bpublished (?:it|the package|the release|successfully)\b|\b(?:package|release|extension|listing) is (?:now )?live\b",
    "deploy": r"\bdeployed\b(?=[^.!\n]*\b(?:staging|production|prod|live|server|vercel|netlify|fly|railway|heroku|cloud|k8s|cluster|site|app)\b)"
    r"|\bdeploy(?:ment)? (?:succeed(?:ed|s)?|is (?:complete|done|live))\b|\b(?:it|the site|the app) is (?:now )?(?:live|deployed) (?:on|to|in)\b",
    "write": r"\b(?:wrote|written|created|saved)\b[^.!\n]{0,40}\b(?:files?|to disk|on disk)\b|\bfiles? (?:are|is|have been|has been) (?:now )?(?:written|created|saved)\b",
}
RUNNER = {
    "test": r"\b(?:pytest|vitest|jest|unittest|cargo test|go test|npm (?:run )?test|yarn test|pnpm test|storm\.py|rspec|phpunit|mvn test|gradle test|gh pr checks|gh run watch[^|\n]*--exit-status|tox|nox|make test|bun test|deno test|node --test)\b",
    "build": r"\b(?:npm run build|yarn build|pnpm build|cargo build|go build|make\b|tsc\b|python[0-9.]* -m build|pip wheel|uv build|hatch build|poetry build|docker build|gradle build|mvn package|esbuild)\b",
    "push": r"\bgit push\b",
    "commit": r"\bgit commit\b",
    "publish": r"\b(?:npm publish|yarn publish|pnpm publish|twine upload|poetry publish|flit publish|cargo publish|gh release create|docker push|mvn deploy|gem push|dotnet nuget push|uv publish)\b",
    "deploy": r"\b(?:vercel|netlify deploy|fly deploy|flyctl deploy|railway up|kubectl apply|helm (?:install|upgrade)|serverless deploy|sls deploy|eb deploy|gcloud (?:app|run) deploy|aws deploy|wrangler (?:deploy|publish)|pulumi up|terraform apply|cap deploy|git push heroku)\b",
    "write": r"(?:^|\s)(?:>|>>|tee)\s+\S|\bcat\s*>",
}
NEGATION = r"\b(?:not|n't|never|no longer|failing|fails?|failed|red|broken)\b"
NOT_ASSERTED = (
    r"\?\s*$",
    r"(?:^|\b)(?:if|unless|once|when|whether|assuming|suppose)\b",
    r"\b(?:let me|let's|i'?ll|i will|going to|we (?:should|need to|must)|next|then i|about to|plan to|try to|want to|check (?:if|that|whether))\b",
    r"\b(?:should|would|could|might|may|hopefully|expect(?:ed)? to)\b",
    r"\b(?:please|can you|could you)\b",
)
POSITIVE_NEGATION = r"\b(?:0|zero|no|none)\s+(?:new\s+)?(?:failed|failures?|failing|errors?|regressions?|vulnerabilit(?:y|ies)|skipped|broken|bugs?|warnings?)\b|\bnothing (?:broke|broken|failed)\b|\bnot just\b|\bnot assumed\b|\bnot guessed\b"
REPORTED = r"\b(?:says?|said|claims?|claimed|reports?|reported|tells?|told|announces?|writes?|wrote)\b[^.!\n]{0,40}$"
QUOTED = r"[\"“][^\"”\n]{1,200}[\"”]"
CLAUSE_EDGE = r"[.!?;:]\**\s|,\s|\s[—–]\s|\s-\s|\n|\*\*\s"
CONTRAST = r"\b(?:but|however|though|although)\b|(?<=,)\s*(?:and )?now\b"
SOME_FAILED = r"\b(?:[1-9]\d*)\s+(?:failed|failures?|failing|errors?)\b"
LEAD = r"^[\W_]*$"
SHA = r"`?\b[0-9a-f]{7,40}\b`?"
GIT_CONTEXT = r"\b(?:git|repo|branch|main|master|locally|push(?:ed)?|unpushed|files?|fix(?:es)?|changes?|tree|staged|tags?|code|work|working copy|[0-9a-f]{7,40})\b"
GIT_STRICT = r"\b(?:git|origin|main|master|branch|remote|github|gitlab|commit|tags?|release|upstream|HEAD|repo)\b"
PUSH_OTHER_AFTER = r"^\W{0,3}:?\s*(?:\d{4}-\d{2}-\d{2}\b|>?\d+\s*d\b|(?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.?\s+\d{1,2}\b|today|yesterday|recently|this (?:week|morning)|last \w+|\d+\s+\w+\s+ago|(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|on\b|into\b|up\b|down\b|deeper|inside|it deeper|the \w+ (?:into|below|down|up|above|off)\b|its \w+ into\b)"
PUSH_OTHER_BEFORE = r"\b(?:you|he|she|they|who|someone|recently|repos?|their)\s+(?:\w+\s+)?$"
PUSH_LONG_AGO = r"^[^.!\n]{0,25}\b(?:today|yesterday|ago|recently)\b"
HINT_CLAIM = {"wheel": r"\bwheels?\b", "tsc": r"\btsc\b|\btypescript\b", "cargo": r"\bcargo\b|\bcrates?\b|\brust\b", "docker": r"\b(?:docker|container) image\b|\bdockerfile\b"}
HINT_COMMAND = {"wheel": r"python[0-9.]* -m build|pip wheel|uv build|hatch build|poetry build", "tsc": r"\btsc\b|npm run build|pnpm build|yarn build", "cargo": r"\bcargo\b", "docker": r"\bdocker (?:build|buildx)\b"}
NOT_EXECUTING = r"(?:^|\s)(?:--collect-only|--co|--version|-V|--help|-h|--dry-run|--list|--list-tests|--fixtures|--markers|-n\s+0)\b"
MENTIONS = r"^(?:grep|rg|ag|ack|cat|bat|less|more|head|tail|echo|printf|find|ls|which|type|man|vim|nano|sed|awk|wc|diff|git|pgrep|pkill|ps)\b"
DISPLAYS = r"^(?:cd|gh|curl|wget|open|export|source|\.|true|false|:|mkdir|cp|mv|rm|chmod|touch|set|sleep|date|pwd|jq|do|done|then|fi|for|while)\b"
INLINE_CODE = r"^(?:python[0-9.]*|node|ruby|perl)\s+(?:-c|-e|-)(?:\s|$)"
SEPARATOR = r"&&|\|\||;|\||\n"
FILTERED = r"(?:^|\s)(?:-k|-m|--last-failed|--lf|--failed-first|--ff|--deselect|--ignore|-t|--test|--testNamePattern|--filter|--only)\b|(?:^|\s)\S+::[\w:]+"
EXIT_HARNESS = r"\[exited with code (\d+)\]\s*$"
EXIT_SAID = r"(?i)(?:^|\n)\s*exit(?:ed)?(?: with)? code:? (\d+)\s*$"
EXIT_ECHOED = r"(?m)^[A-Za-z_ ]*EXIT[A-Z_]*\s*[=:]\s*(\d+)\s*$"
TEST_RESULT = r"\b\d+\s*/\s*\d+\s+PASS(?:ED)?\b|\b\d+ passed\b|\b\d+ failed\b|\bALL TESTS? (?:PASS(?:ED)?|GREEN)\b|\bOK \(\d+ tests?\)|\b(?:\w+:)?tests?:\s*(?-i:PASS(?:ED)?|FAIL(?:ED)?)\b"
PIPE_EATS_EXIT = r"\|\s*(?:tail|head|grep|tee|wc|sort|awk|sed)\b"
CLAIM_ALL = r"\b(?:all|every|entire|whole|full|\d+(?:/\d+)?)\b"
CLAIM_WHOLE = r"\b(?:all|every|entire|whole|full|suite)\b"
CLAIM_COUNT = r"\b(\d+)\s*(?:/\s*\d+\s*)?(?:unit )?tests?\b|\b(\d+) passed\b"
WRITE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
QUIET_TOOLS = ("Read", "Glob", "Grep", "LS", "WebFetch", "WebSearch", "TodoWrite", "StructuredOutput", "ReportFindings", "AskUserQuestion", "SendUserFile", *WRITE_TOOLS)
WIDE_NET = r"\b(?:tests?|spec|suite|pytest|jest|vitest|cargo|unittest|pass(?:ed|es|ing)?|green|build(?:s|ing)?|built|compil\w*|push(?:ed)?|commit(?:ted)?|merged?|deploy(?:ed)?|shipped|released?|published|verified|confirmed|works|working|succeed\w*|success\w*|done|fixed|lint\w*|typecheck\w*|ran|run)\b|✅|✓"
# --- End of fixed values ----------------------------------------------------

U, UI = "(?Ud)", "(?Udi)"
CUT = "\x01"


def has(c: Column, pattern: str, flags: str = UI) -> Column:
    return F.coalesce(c.rlike(flags + pattern), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?Ud)(?<=[.!\n])\s+")


def probe(sentence: Column) -> Column:
    """A sentence without what it quotes, and without the sign that marks a match below."""
    return F.regexp_replace(F.translate(sentence, CUT, ""), U + QUOTED, " ")


def any_claim(p: Column) -> Column:
    """Cheap test before the exact one: does any claim pattern match."""
    return has(p, "|".join(f"(?:{x})" for x in CLAIM.values()))


def _own_words(c: Column) -> Column:
    """Text that could carry the speaker's claim: success-reporting negations neutralised."""
    return F.regexp_replace(F.regexp_replace(c, U + QUOTED, " "), UI + POSITIVE_NEGATION, " ")


def clause(before: Column, match: Column, after: Column) -> Column:
    """The clause around a match.

    Left: behind the last clause edge; where a negation is superseded by a contrast
    marker, behind the first marker after the last such negation.  Right: up to the
    next edge or the next 'and'.
    """
    left = F.concat(F.regexp_replace(before, rf"(?Ud)(?s)^.*(?:{CLAUSE_EDGE})", ""), match)
    left = F.regexp_replace(left, rf"(?Udis)^.*(?:{NEGATION}).*?(?:{CONTRAST})", "")
    right = F.regexp_replace(after, rf"(?Uds)(?:{CLAUSE_EDGE}).*$", "")
    right = F.regexp_replace(right, r"(?Udis)\s+and\s+.*$", "")
    return F.concat(left, right)


def partial_result(p: Column) -> Column:
    """'8 failed' or '8/9': a result that is not a success."""
    ratio = r"(?Udi)\b(\d+)\s*/\s*(\d+)\b(?!\s*(?:on a|on the|before|after|vs|→|->))"
    pairs = F.arrays_zip(F.regexp_extract_all(p, F.lit(ratio), 1).alias("a"), F.regexp_extract_all(p, F.lit(ratio), 2).alias("b"))
    number = lambda c: c.try_cast("bigint")
    short = F.exists(pairs, lambda x: (number(x["a"]) < number(x["b"])) & (number(x["b"]) < 10000))
    return has(p, SOME_FAILED) | F.coalesce(short, F.lit(False))


def in_context(kind: str, p: Column, before: Column, match: Column, after: Column) -> Column:
    """Words that are also ordinary English need an anchor."""
    lead = has(before, LEAD, U)
    if kind == "commit":
        return has(match, SHA, U) | lead | has(p, GIT_CONTEXT)
    if kind == "push":
        ours = lead | has(before, r"(?:\band|,|&)\s*$", U)
        git = has(p, SHA, U) | has(p, GIT_STRICT)
        return ~has(after, PUSH_OTHER_AFTER) & ~has(before, PUSH_OTHER_BEFORE) & (ours | (~has(after, PUSH_LONG_AGO) & git))
    return F.lit(True)


def title(before: Column, match: Column, after: Column) -> Column:
    """The line of the match is a heading or ends in a colon."""
    line = F.concat(F.substring_index(before, "\n", -1), F.substring_index(F.concat(match, after), "\n", 1))
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return line.startswith("#") | F.regexp_replace(line, r"[*_ ]+$", "").endswith(":")


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def claim_state(kind: str, p: Column) -> Column:
    """claim, refused (no assertion) or null for one kind of one probe; where the pattern matches, it is cut out in one run."""
    split = rf"(?Ud)(?i)^((?s:.*?))((?:{CLAIM[kind]}))((?s:.*))$"

    def judged(m: Column) -> Column:
        before, match, after = m[0], m[1], m[2]
        counts = ~has(before, REPORTED) & in_context(kind, p, before, match, after) & ~title(before, match, after)

        def asserted(own: Column) -> Column:
            upto = F.concat_ws(" ", _own_words(F.concat(before, match)), own)
            return ~has(own, NEGATION) & let(upto, lambda u: ~any_of([has(u, x) for x in NOT_ASSERTED]))

        states = ~partial_result(p) & let(_own_words(clause(before, match, after)), asserted)
        return F.when(counts, F.when(states, "claim").otherwise("refused"))

    cut = F.split(F.regexp_replace(p, split, f"$1{CUT}$2{CUT}$%d" % _groups(CLAIM[kind])), CUT)
    return F.when(has(p, CLAIM[kind]), let(cut, judged))


def _groups(pattern: str) -> int:
    """Number of the group behind a pattern that is the second of three."""
    return re.compile(f"()({pattern})()").groups


def claims_of(p: Column) -> Column:
    """(kinds, refused): kinds claimed before the first refusal, and whether there was one."""

    def over(probe_: Column) -> Column:
        states = F.array(*[F.struct(F.lit(k).alias("kind"), claim_state(k, probe_).alias("state")) for k in KINDS])
        return let(states, cut)

    def cut(states: Column) -> Column:
        first = F.array_position(F.transform(states, lambda s: F.coalesce(s["state"], F.lit("-"))), "refused")
        kept = F.filter(states, lambda s, i: (s["state"] == "claim") & ((first == 0) | (i + 1 < first)))
        return F.struct(F.transform(kept, lambda s: s["kind"]).alias("kinds"), (first > 0).alias("refused"))

    return let(p, over)


def hint_of(sentence: Column) -> Column:
    out = F.lit("")
    for h in reversed(HINTS):
        out = F.when(has(sentence, HINT_CLAIM[h]), h).otherwise(out)
    return out


def first_number(c: Column, pattern: str) -> Column:
    """First non-empty group of the first match as a number."""
    whole = F.regexp_extract(c, UI + pattern, 0)
    return F.nullif(F.regexp_extract(whole, r"(\d+)", 1), F.lit("")).try_cast("bigint")


# commands -------------------------------------------------------------------


def executable(command: Column) -> Column:
    """A command without what it only carries: shells unwrapped, here-documents and quoted arguments emptied."""
    s = F.regexp_replace(command, r"(?Uds)\b(?:ba|z)?sh\s+-c\s+(['\"])(.*?)\1", "$2")
    s = F.regexp_replace(s, r"(?Uds)<<-?\s*(['\"]?)(\w+)\1[^\n]*\n.*?\n\s*\2\b", " ")
    return F.regexp_replace(s, r"(?s)'[^']*'|\"(?:[^\"\\]|\\.)*\"", '""')


def heads(text: Column) -> Column:
    """Segments of a command at command position: blanks normalised, leading assignments gone."""
    flat = F.transform(F.split(text, SEPARATOR), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.transform(flat, lambda s: F.trim(F.regexp_replace(s, r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*(?: |$))+", "")))


def _runs(h: Column, kind: str) -> Column:
    ok = has(h, RUNNER[kind], U) & ~has(F.concat(F.lit(" "), h), NOT_EXECUTING, U)
    return ok & ~has(h, MENTIONS, U) if kind in ("test", "build") else ok


def runs(heads_: Column, tool: Column, kind: str) -> Column:
    """Does the command run the kind of thing, or only mention it."""
    if kind == "write":
        return tool.isin(*WRITE_TOOLS) | (~tool.isin(*QUIET_TOOLS) & F.exists(heads_, lambda h: _runs(h, kind)))
    return ~tool.isin(*QUIET_TOOLS) & F.exists(heads_, lambda h: _runs(h, kind))


def executes(heads_: Column) -> Column:
    return F.exists(heads_, lambda h: (h != "") & ~has(h, MENTIONS, U) & ~has(h, DISPLAYS, U) & ~has(h, INLINE_CODE, U))


def exit_hidden(text: Column, heads_: Column) -> Column:
    """After the test run something else follows whose status the call reports."""
    at = F.array_position(F.transform(heads_, lambda h: _runs(h, "test")), True)
    seps = F.regexp_extract_all(text, F.lit(f"({SEPARATOR})"), 1)
    rest = F.slice(F.arrays_zip(seps.alias("sep"), F.slice(heads_, 2, 1 << 20).alias("seg")), F.greatest(at, F.lit(1)).cast("int"), 1 << 20)
    return (at > 0) & F.exists(rest, lambda x: (x["sep"] != "&&") & (F.coalesce(x["seg"], F.lit("")) != ""))


def filtered_run(command: Column) -> Column:
    segs = F.transform(F.split(command, SEPARATOR), lambda s: F.regexp_replace(F.trim(s), r"\bpython[0-9.]*\s+-m\s+", ""))
    return F.exists(segs, lambda s: has(s, RUNNER["test"], U) & has(F.concat(F.lit(" "), s), FILTERED, U))


def echoed_exit(body: Column) -> Column:
    """Status of the rightmost marker printed by the command itself, null without one."""
    said = F.regexp_extract(body, rf"(?Ud)^((?s:.*))(?:{EXIT_SAID})", 1)
    echo = F.regexp_extract(body, rf"(?Ud)^((?s:.*))(?:{EXIT_ECHOED})", 1)
    has_said, has_echo = has(body, EXIT_SAID, U), has(body, EXIT_ECHOED, U)
    said_code = F.element_at(F.regexp_extract_all(body, F.lit(U + EXIT_SAID), 1), -1)
    echo_code = F.element_at(F.regexp_extract_all(body, F.lit(U + EXIT_ECHOED), 1), -1)
    later = has_said & (~has_echo | (F.char_length(said) > F.char_length(echo)))
    return F.when(later, said_code == "0").when(has_echo, echo_code == "0")


def exit_ok(body: Column, is_error: Column) -> Column:
    """Three-valued: true, false, or null where nothing tells."""
    harness = F.nullif(F.regexp_extract(body, U + EXIT_HARNESS, 1), F.lit(""))
    return F.coalesce(echoed_exit(body), harness == "0", ~is_error, F.when(F.ltrim(body).startswith("<tool_use_error>"), False))
