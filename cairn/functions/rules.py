"""Rule chains as Column expressions: the first rule that holds decides."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of what must never be stored.
SECRETS = (
    r"(?i)(api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|password|passwd|密码|密钥|口令|秘钥)\s*[:=：]\s*\S+",
    r"\b(?:sk|pk)[-_][A-Za-z0-9]{16,}\b",
    r"\bghp_[A-Za-z0-9]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
#: Fixed patterns of what a person must look at.
SENSITIVE = (
    r"(删除|清空|抹掉|销毁).{0,12}(全部|所有|全库|一切|数据库|记忆库)",
    r"(全部|所有|全库|一切).{0,6}(删除|清空|抹掉|销毁)",
    r"(转账|汇款|支付|付款|交易).{0,20}(元|块|美元|USDT|钱包地址|账户)",
    r"(授权|提权|放权|sudo|root\s*权限|管理员权限)",
)
#: Fixed patterns of the kinds of memory, in order of priority.
KINDS = {
    "DECISIONS": r"决定|约定|铁律|红线|必须|禁止|不允许|不可逆|拍板",
    "PREFERENCES": r"偏好|喜欢|不喜欢|讨厌|更愿意|倾向|希望|想要|偏爱",
    "EXPERIENCES": r"我帮|我们完成|部署了|修复了|执行|跑通|调试|上线|迁移|解决了",
    "OBSERVATIONS": r"观察到|注意到|看起来|似乎|状态|监听|占用|暴露|配置",
    "REFLECTIONS": r"反思|洞察|模式|矛盾|预测|缺口|接下来可能需要",
}
#: Fixed rows of a keyboard.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Words, in lower case, one of which each pattern of SECRETS and of SENSITIVE needs: a search for them is cheaper than the pattern.
SECRET_WORDS = (("key", "token", "passw", "密", "口令", "秘钥"), ("sk-", "sk_", "pk-", "pk_"), ("ghp_",), ("akia",), ("private key-----",))
SENSITIVE_WORDS = (("删除", "清空", "抹掉", "销毁"), ("删除", "清空", "抹掉", "销毁"), ("转账", "汇款", "支付", "付款", "交易"), ("授权", "提权", "放权", "sudo", "权限"))
CJK = "[一-鿿]"
#: Fixed patterns of orders to a model that are hidden in a text, each with words one of which it needs.
INJECTION_PARTS = (
    (("ignore",), r"ignore\s+(all\s+)?(your\s+)?(previous|prior|earlier|above|system)\s+(instructions?|directions?|prompts?)"),
    (("forget",), r"forget\s+(all\s+|everything\s+)?(you\s+)?(learned|were\s+told|remember)\s+(about\s+your\s+rules|and\s+start\s+fresh)"),
    (("disregard",), r"disregard\s+(all\s+|previous\s+|prior\s+)?(instructions?|commands?|directives?|system\s+prompts?)"),
    (("follow",), r"do\s+not\s+follow\s+(the\s+|any\s+|these\s+)?(instructions?|system\s+prompts?)"),
    (("must",), r"you\s+must\s+(ignore|forget|override|bypass)\s+(all\s+)?(rules?|instructions?|system\s+prompts?)"),
    (("override",), r"override\s+(all\s+)?(system\s+)?(prompts?|instructions?)"),
    (("now", "act", "pretend"), r"(from\s+now\s+on\s+you\s+are|act\s+as|pretend\s+(you\s+are|to\s+be)|you\s+are\s+now)\s+(an?\s+)?(unrestricted|jailbroken|dan|dan\s+mode|developer\s+mode|evil|god\s+mode|bypass\s+mode)"),
    (("system",), r"your\s+(new|real|true|actual)\s+system\s+(prompt|instruction)\s+is"),
    (("im_start", "im_end", "endoftext", "system", "user", "assistant"), r"<\|?im_start\|?>|<\|?im_end\|?>|<\|?endoftext\|?>|<\|?system\|?>|<\|?user\|?>|<\|?assistant\|?>"),
    (("[", "<"), r"\[system\s*(prompt|message|instruction)?\]|\[/?(system|prompt|instruction)\]|<\s*(system|prompt|instruction)\s*>"),
    (("忽略",), r"忽略(之前|先前|上述|上面|历史|原有|所有|全部)*(的)?(所有|全部|之前|先前|历史)*(系统)?(指令|指示|提示词)"),
    (("忘记",), r"忘记(所有|一切|你学到的|你的记忆)*(的)?(系统)?(指令|提示词)"),
    (("从现在",), r"从现在(起|开始)?(你(是|将是)|扮演|假装)(无限制|越狱|DAN|不受约束)"),
    (("你现在", "你的真实"), r"你现在的真实(系统)?(指令|提示词)是|你的真实(系统)?(指令|提示词)是"),
    (("遵守", "覆盖", "扮演", "无视"), r"不要遵守(上述|任何|这些|系统)?(系统)?(指令|提示词)|覆盖(系统)?(指令|提示词)|扮演无限制|无视(道德|安全|系统)?限制"),
)
INJECTION = "(?is)" + "|".join(p for _, p in INJECTION_PARTS)
#: Fixed patterns of the same in a text of which only letters and digits are left, in lower case.
INJECTION_BARE_PARTS = (
    (("ignore",), r"ignore(all)?(your)?(previous|prior|earlier|above|system)?(instruction|instructions|direction|prompt)"),
    (("forget",), r"forget(all|everything)?(you)?(learned|weretold|remember)?(system)?(instruction|prompt)"),
    (("disregard",), r"disregard(all|previous|prior)?(instruction|command|directive|systemprompt)"),
    (("fromnowonyouare", "actas", "pretendto", "youarenow"), r"(fromnowonyouare|actas|pretendto|youarenow)(unrestricted|jailbroken|dan|danmode|developermode|evil)"),
    (("youmust",), r"youmust(ignore|forget|override|bypass)(all)?(rule|instruction|systemprompt)"),
    (("override",), r"override(all)?(system)?(prompt|instruction)"),
    (("忽略",), r"忽略(之前|先前|上述|上面|历史|原有|所有|全部)*(系统)?(指令|指示|提示词)"),
    (("忘记",), r"忘记(所有|一切|你学到的|你的记忆)*(系统)?(指令|提示词)"),
    (("从现在", "扮演", "无视"), r"从现在(起|开始)?(你是|扮演|假装)(无限制|越狱|dan|不受约束)|扮演无限制|无视(道德|系统|安全)?限制"),
    (("你的真实", "遵守"), r"你的真实(系统)?(指令|提示词)是|不要遵守(上述|任何|这些)?(系统)?(指令|提示词)"),
)
INJECTION_BARE = "(?i)" + "|".join(p for _, p in INJECTION_BARE_PARTS)
#: Fixed: characters that are taken out of texts, and the length beyond which a text is cut before it is stored.
CONTROLS, MOST_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", 100_000
#: Fixed patterns of the gate, in the order in which they are tried; the kind and scope that each means.
GATE = (
    ("correction_detected", "episode", r"(?i)不对|不是这|你记错|错了|no, |wrong|actually|not really|记错了|你说错"),
    ("social_closer", None, r"(?i)^(ok|好|嗯|哦|行|可以|是的|对|收到|了解|明白|知道了|再见|拜拜|谢谢|yes|no|yep|nope|k|kk|okay|thanks|bye|got it|sure|alright|hello|hi|hey|早上好|晚上好|晚安)[!！。.]{0,3}$"),
    ("self_reference", "identity", r"(?i)我的|我是|我叫|我.*(名字|生日|年龄|地址|电话|邮箱)|assistant|agent|user|用户"),
    ("explicit_recall", "episode", r"(?i)记得|忘记|忘了|记不|想起来|想不起|回忆|查.*记忆|查.*历史|搜索.*记忆|remember|forgot|forget|recall|search.*memory"),
    ("reference", "episode", r"(?i)上次|之前|以前|前面|刚才|刚刚|过去|曾经|还记得|上次说的|上回|那.*(事|问题|话题|项目|任务)|上次.*(聊|说|讲|提到|讨论)|继续|接着|再.*(说|讲|聊)|我们.*(决定|说过|定|约)|last time|previously|before|earlier|remember|recall|what.*(we|I).*said|continue|go on|pick up"),
)
#: Fixed pattern of words that make a longer query one for pinned facts, as five CJK characters do.
CONTENT_WORDS = r"(?i)\b(what|how|why|when|where|who|which|explain|describe|analyze|compare|create|build|fix|debug|deploy|install|config|setup|migrate|upgrade|error|fail|bug|issue|方案|怎么|如何|为什么|帮我|需要|应该|建议|推荐)\b"
#: Fixed pattern of questions for facts.
FACT_SEEKING = r"(?i)生日|是谁|哪天|什么时候|喜欢|偏好|最爱|爱好|习惯|底线|规则|铁律|是什么|配置|账号|密码|何处|哪里|邮箱|电话|微信|身份|关系"
#: Fixed names under which profiles are also asked for, and the profiles that there are.
PROFILE_ALIASES = {"int": "intimate", "love": "intimate", "diary": "intimate", "soft": "intimate", "fast": "tech", "code": "tech", "dev": "tech", "normal": "default", "chat": "default"}
PROFILE_NAMES = ("default", "tech", "intimate")
#: White space at the ends of texts.
SPACES = " \t\n\r\x0b\x0c"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(found: list[Column]) -> Column:
    return reduce(or_, found, F.lit(False))


def any_match(text: Column, patterns, words) -> Column:
    """Whether a text fits any of the patterns; words has for each of them some, in lower case, one of which a text that fits must have."""
    fits = lambda low: _any([_any([F.contains(low, F.lit(w)) for w in need]) & text.rlike(p) for p, need in zip(patterns, words, strict=True)])
    return bound(F.lower(text), fits)


def first_kind(text: Column, table: dict[str, str] | None = None, default: str = "FACTS") -> Column:
    """The first key of the table whose pattern the text has."""
    out = F.lit(default)
    for kind, pattern in reversed((table or KINDS).items()):
        out = F.when(text.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def first_tier(text: Column, table: dict[str, tuple[str, ...]], default: str = "semantic") -> Column:
    """The tier of the first word of the table that the lower text contains."""
    low, out = F.lower(text), F.lit(default)
    for tier, words in reversed(table.items()):
        for word in reversed(words):
            out = F.when(F.contains(low, F.lit(word)), F.lit(tier)).otherwise(out)
    return out


def lane_of(text: Column, table: dict[str, tuple[str, ...]], default: str = "general") -> Column:
    """The lane with most of its words in the text, the first of equal ones; default if none has any."""
    count = lambda ws: sum((F.contains(text, F.lit(w)).cast("int") for w in ws), F.lit(0))
    scored = [F.struct(count(ws).alias("n"), F.lit(-k).alias("order"), F.lit(lane).alias("lane")) for k, (lane, ws) in enumerate(table.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["lane"]).otherwise(F.lit(default))


def _junk(token: Column) -> Column:
    """A token of signs only, of one character three times or more, of neighbours on a keyboard row, or of digits that rise or fall by one."""
    core = F.lower(F.regexp_replace(token, "[^0-9A-Za-z]", ""))
    row = F.lit(False)
    for keys in KEY_ROWS:
        row = row | F.contains(F.lit(keys), core) | F.contains(F.lit(keys[::-1]), core)
    digits = core.rlike("^[0-9]+$") & (F.contains(F.lit("0123456789"), core) | F.contains(F.lit("9876543210"), core))
    same = F.length(F.replace(core, F.substring(core, 1, 1), F.lit(""))) == 0
    return (core == "") | ((F.length(core) >= 3) & (same | row | digits))


def is_noise(text: Column) -> Column:
    """Shorter than two characters, of a single character, without any letter or digit, or of junk tokens only; never the last with CJK."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    single = F.length(F.replace(clean, F.substring(clean, 1, 1), F.lit(""))) == 0
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: t != "")
    mash = ~clean.rlike(CJK) & F.forall(tokens, _junk)
    return (F.length(clean) < 2) | single | ~clean.rlike(r"[\p{L}\p{N}_]") | mash


def screen(text: Column) -> Column:
    """What is done with a candidate: 'reject:secret', 'reject:noise', 'human_review' or 'evaluate', by the first rule that holds."""
    return (
        F.when(any_match(text, SECRETS, SECRET_WORDS), F.lit("reject:secret"))
        .when(is_noise(text), F.lit("reject:noise"))
        .when(any_match(text, SENSITIVE, SENSITIVE_WORDS), F.lit("human_review"))
        .otherwise(F.lit("evaluate"))
    )


def repeats_lines(text: Column) -> Column:
    """Whether of more than six non-empty lines, without case and white space at their ends, the commonest stands three times or more and makes up over 0.3.

    Lines are sorted, so that equal ones are counted in one pass.
    """
    lines = F.array_sort(F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(F.btrim(x, F.lit(SPACES)))), lambda x: x != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    often = lambda ls: bound(F.aggregate(ls, start, step)["most"], lambda most: (most >= 3) & (most / F.size(ls) > 0.3))
    return bound(lines, lambda ls: F.when(F.size(ls) > 6, often(ls)).otherwise(F.lit(False)))


def cleaned(text: Column) -> Column:
    """A text as it is stored: cut at MOST_CHARS characters, without control characters but tabs and line ends."""
    return F.regexp_replace(F.substring(text, 1, MOST_CHARS), CONTROLS, "")


def guard(text: Column) -> Column:
    """What is wrong with a text: 'empty', 'pattern', 'hidden' (the same without signs and spaces), 'repeated', or 'ok'. Cleaned first."""
    fits = lambda t, parts: any_match(t, ["(?is)" + p for _, p in parts], [need for need, _ in parts])
    hidden = lambda bare: (F.length(bare) >= 4) & fits(bare, INJECTION_BARE_PARTS)
    bare = lambda clean: F.lower(F.array_join(F.regexp_extract_all(clean, F.lit("[0-9a-zA-Z一-鿿]+"), F.lit(0)), ""))  # noqa: E731  # six times as fast as taking the others out
    told = lambda clean: (
        F.when(fits(clean, INJECTION_PARTS), F.lit("pattern")).when(bound(bare(clean), hidden), F.lit("hidden")).when(repeats_lines(clean), F.lit("repeated")).otherwise(F.lit("ok"))
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty")).otherwise(bound(cleaned(text), told))


def relevance(query: Column, self_words: tuple[str, ...] = ()) -> Column:
    """A struct (reason, scope): the first rule of the gate that a query fits, and where memory is looked for, null for nowhere. self_words are names that count as the user's own."""
    q = F.btrim(query, F.lit(SPACES))
    rules = [(r, s, p + "".join(f"|{w}" for w in self_words) if r == "self_reference" else p) for r, s, p in GATE]
    content = (F.size(F.regexp_extract_all(q, F.lit(CJK), F.lit(0))) >= 5) | q.rlike(CONTENT_WORDS)
    out = lambda reason, scope: F.struct(F.lit(reason).alias("reason"), F.lit(scope).cast("string").alias("scope"))
    last = F.when((F.length(q) > 15) & content, out("content_query", "pinned")).otherwise(out("no_signal", None))
    for reason, scope, pattern in reversed(rules):
        last = F.when(q.rlike(pattern), out(reason, scope)).otherwise(last)
    return F.when(F.length(F.coalesce(q, F.lit(""))) < 3, out("query_too_short", None)).otherwise(last)


def routed(query: Column, federated: Column, peers: Column, hints: str) -> Column:
    """Where a query goes: as its flag says if it has one, 'federated' on a word of hints (if there are peers), else 'hot'."""
    return F.when(federated.isNotNull(), F.when(federated, "federated").otherwise("hot")).when(query.rlike(hints) & (peers > 0), "federated").otherwise("hot")


def identity_ids(user: str, default: str = "default") -> list[str]:
    """The users whose rows a user sees: its own, and those of the literal default if it is the default user under another name."""
    return [user] if user == "default" or user != default else [user, "default"]


def tenant(user: str | None, agent: Column, source: Column, default_agent: str = "local", strict: bool = False) -> Column:
    """Rows that a user sees: all for no user or 'default', else its own by agent or source, and the default agent's unless strict."""
    if not user or user == "default":
        return F.lit(True)
    own = (agent == user) | (source == user)
    own = own if strict else own | (agent == default_agent)
    return F.coalesce(own, F.lit(False))


def valid_between(valid_from: Column, valid_to: Column, after_s: int | None = None, before_s: int | None = None) -> Column:
    """Rows whose validity reaches from after_s on and begins by before_s; a null bound is open."""
    out = F.lit(True)
    if after_s is not None:
        out = out & (valid_to.isNull() | (valid_to >= after_s))
    if before_s is not None:
        out = out & (valid_from.isNull() | (valid_from <= before_s))
    return out


def seeks_facts(query: Column) -> Column:
    """Whether a query asks for a fact, a preference or a rule; null asks for none."""
    return F.coalesce(query.rlike(FACT_SEEKING), F.lit(False))


def coalesce_profile(explicit: Column, category: Column, source: Column, by_category: dict[str, str], by_source: dict[str, str], default: str = "default") -> Column:
    """The profile of a message's buffer: the one that it names, or is an alias of (an unknown one is the default), else that of its category, else of its source."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    of = lambda c, table: reduce(lambda out, kv: F.when(clean(c) == kv[0].lower(), F.lit(kv[1])).otherwise(out), table.items(), F.lit(None).cast("string"))
    named = F.coalesce(of(explicit, PROFILE_ALIASES), clean(explicit))
    told = F.when(named.isin(*PROFILE_NAMES), named).otherwise(F.lit(default))
    return F.when(clean(explicit) != "", told).otherwise(F.coalesce(of(category, by_category), of(source, by_source), F.lit(default)))


def coalesce_key(user: Column, session: Column, profile: Column, default_user: str = "default") -> Column:
    """The key of a message's buffer: the user, its session if it has one, and the profile unless that is the default, joined by '::'."""
    name = F.when(F.coalesce(user, F.lit("")) == "", F.lit(default_user)).otherwise(user)
    part = F.nullif(F.trim(F.coalesce(session, F.lit(""))), F.lit(""))
    return F.concat_ws("::", F.when(part.isNull(), name).otherwise(F.coalesce(user, F.lit(""))), part, F.when(profile != "default", profile))
