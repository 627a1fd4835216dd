"""Editorial rules, keyword flag and event key as column expressions.

Patterns run with Unicode classes and case folding (``(?iU)``), so word edges and
case behave alike for every script. No expression needs Python.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
ACADEMIC = r"(?:\barxiv\b|\bpaper\b|\bpreprint\b|\bstudy\b|\brandomi[sz]ed\s+controlled\b|\bresearch\s+evaluation\b|\balignment\s+behavio(?:u)?r\b|论文|学术|研究论文|科研|模型原理|模型训练|对齐行为)"
ACADEMIC_EXCEPTION = r"(?:\b(?:is|are|now)\s+available\b|\blaunch(?:es|ed|ing)?\b|\brelease[sd]?\s+(?:to|for)\b|\broll(?:s|ed|ing)?\s+out\b|\bproduction\s+(?:deployment|service|use|availability)\b|\bdeployed\s+in\s+production\b|\bpricing\b|\bprice\s+(?:cut|change|drops?)\b|\blower\s+[^.。]{0,40}(?:cost|latency)\b|\bpolicy\s+(?:change|rule|update)\b|\bregulat(?:ion|ory)\s+(?:change|rule|update)\b|\bsecurity\s+(?:issue|update|vulnerability|advisory)\b|现已可用|正式上线|正式发布|投入生产|生产部署|价格调整|降价|成本降低|政策变化|监管规则|安全漏洞)"
SPONSORED = r"(?:\bpresented\s+by\b|\bpartner\s+content\b|\bsponsored\b|赞助内容|商业推广)"
BENCHMARK = r"(?:benchmark|基准测试|评测集|leaderboard|排行榜)"
ALWAYS_LOW_VALUE = r"(?:泛教程|generic tutorial|documentation-only|no new product facts|how to [^.。]{0,80}template|template[- ]tutorial|tutorial [^.。]{0,80}template|example notebooks?|notebook examples?)"
LOW_VALUE = r"(?:小版本|补丁|修复连接器|超时配置|\b(?:v|version)\s*\d+\.\d+\.\d+|\b\d+\.\d+\.\d+\b)"
DEVELOPER = r"(?:\bsdk\b|\bapi\b|接口协议|开发框架|framework|repository|仓库|代码工具|agent runtime|runtime|开源项目|developer|开发者)"
CORPORATE = r"(?:融资|估值|募资|轮融资|高管|任命|离职|收购|投资|funding|valuation|executive|appointed|resigns|acquisition|investment)"
CONCRETE_IMPACT = r"(?:产品|功能|套餐|订阅|价格|免费|free|tier|开放|上线|发布|推出|用户|客户|消费者|企业|部署|采用|购物|平台|政策|监管|规则|合规|市场|可用|访问|服务|开发者|production|enterprise|availability|available|access|cost|latency|compatibility|migration|support|supports|configured)"
GITHUB_RELEASE = r"(?:\brelease\b|\bchangelog\b|patch|修复|版本|\bversion\b|\bv\d+(?:\.\d+){1,3}\b|\b\d+\.\d+\.\d+\b)"
HIGH_IMPACT = r"(?:安全漏洞|漏洞|security|vulnerability|重大故障|中断|outage|大规模落地|大规模采用|生产部署|成本降低|成本|性能提升|performance|latency|adoption|breaking change|重大版本|架构变化|migration|compatibility|enterprise|production|availability|third-party gateway|gateway provider|open models?|可用范围|访问门槛|主流产品|稳定性|stability|reliability|major release)"
BENCHMARK_IMPACT = r"(?:生产部署|大规模采用|production deployment|production deployments|deployed in production|enterprise adoption|lower [^.。]{0,40}cost|cost [^.。]{0,40}reduc|lower [^.。]{0,40}latency|性能提升|performance improvement|latency)"
KEYWORDS = r"\b(?:release|launch|introducing)\b|发布|推出|开源"
EVENT_LAUNCH = r"(?:\blaunch(?:es|ed|ing)?\b|\breleas(?:e|es|ed|ing)\b|\bintroduc(?:e|es|ed|ing)\b|\bannounc(?:e|es|ed|ing)\b|\bnow available\b|正式发布|发布|推出|上线|开放)"
EVENT_PRICE = r"(?:\bpric(?:e|es|ed|ing)\b|\bcost\b|价格|降价|费用)"
EVENT_UPDATE = r"(?:\bupdat(?:e|es|ed|ing)\b|\bupgrad(?:e|es|ed|ing)\b|更新|升级)"
NO_MORE = r"(?![a-z0-9])"
VERSIONED_PRODUCT = r"(?<![a-z0-9])([a-z][a-z0-9]*[\s_-]*\d+(?:\.\d+)*)" + NO_MORE
LATIN_TOKEN = r"\b[a-z][a-z0-9-]{2,}\b"
EVENT_STOPWORDS = [
    "agent", "ai", "announce", "announced", "announces", "anthropic", "app", "assistant", "available", "enterprise", "google",
    "introduce", "introduced", "introduces", "launch", "launched", "launches", "meta", "microsoft", "model", "new", "official",
    "officially", "openai", "platform", "product", "release", "released", "releases", "service", "system", "teams", "tool", "users",
]
TOPIC = r"\b(?:AI|artificial intelligence|LLMs?|large language models?|GPT|Claude|Gemini|Llama|Mistral|DeepSeek|ChatGPT|Copilot|Perplexity|Stable Diffusion|agents?|generative)\b|大模型|人工智能|生成式|智能体|豆包|文心|千问|混元|智谱|MiniMax"
REJECTED_TITLE = r"\b(?:help|question|rumou?r|unconfirmed|meme|showcase)\b|self[- ]?promo|\bmy app\b|\bi built\b"
SECRETS = (
    r"(?:(?<!\w)(?:\\?[\"'])?(?:(?:llm[_-]?)?api[_ -]?key|anthropic[_-]auth[_-]token|github[_-]token|access[_-]token|secret[_-](?:access[_-])?key|client[_-]secret)(?:\\?[\"'])?\s*[:=]\s*(?:\\?[\"'])?[A-Za-z0-9_./+=-]{8,}"
    r"|\bauthorization\b\s*[:=]\s*bearer\s+[A-Za-z0-9_./+=-]{8,}|\bsk-[A-Za-z0-9][A-Za-z0-9_-]{15,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_[A-Za-z0-9_]{20,}|\bAIza[A-Za-z0-9_-]{20,}|\bAKIA[A-Z0-9]{16}\b|\bxox[baprs]-[A-Za-z0-9-]{16,})"
)


#: Of these, a lower-cased text that matches the pattern holds at least one. A plain search for them is
#: many times faster than trying each branch of a pattern at each place, and most texts hold none.
CORES = {
    ACADEMIC: ["arxiv", "paper", "preprint", "study", "randomi", "research", "alignment", "论文", "学术", "科研", "模型原理", "模型训练", "对齐行为"],
    ACADEMIC_EXCEPTION: ["available", "launch", "release", "roll", "production", "pric", "lower", "policy", "regulat", "security", "现已可用", "正式上线", "正式发布", "投入生产", "生产部署", "价格调整", "降价", "成本降低", "政策变化", "监管规则", "安全漏洞"],
    SPONSORED: ["presented", "partner", "sponsored", "赞助内容", "商业推广"],
    BENCHMARK: ["benchmark", "leaderboard", "基准测试", "评测集", "排行榜"],
    ALWAYS_LOW_VALUE: ["tutorial", "泛教程", "documentation-only", "no new product facts", "how to", "notebook"],
    LOW_VALUE: ["小版本", "补丁", "修复连接器", "超时配置"],
    DEVELOPER: ["sdk", "api", "framework", "repository", "runtime", "developer", "接口协议", "开发框架", "仓库", "代码工具", "开源项目", "开发者"],
    CORPORATE: ["funding", "valuation", "executive", "appointed", "resigns", "acquisition", "investment", "融资", "估值", "募资", "高管", "任命", "离职", "收购", "投资"],
    CONCRETE_IMPACT: ["free", "tier", "production", "enterprise", "availab", "access", "cost", "latency", "compatibility", "migration", "support", "configured", "产品", "功能", "套餐", "订阅", "价格", "免费", "开放", "上线", "发布", "推出", "用户", "客户", "消费者", "企业", "部署", "采用", "购物", "平台", "政策", "监管", "规则", "合规", "市场", "可用", "访问", "服务", "开发者"],
    HIGH_IMPACT: ["security", "vulnerability", "outage", "performance", "latency", "adoption", "breaking change", "migration", "compatibility", "enterprise", "production", "availability", "gateway", "open model", "stability", "reliability", "major release", "漏洞", "重大故障", "中断", "大规模落地", "大规模采用", "生产部署", "成本", "性能提升", "重大版本", "架构变化", "可用范围", "访问门槛", "主流产品", "稳定性"],
    BENCHMARK_IMPACT: ["production", "adoption", "cost", "latency", "performance", "生产部署", "大规模采用", "性能提升"],
    TOPIC: ["ai", "artificial", "llm", "language model", "gpt", "claude", "gemini", "llama", "mistral", "deepseek", "copilot", "perplexity", "diffusion", "agent", "generative", "大模型", "人工智能", "生成式", "智能体", "豆包", "文心", "千问", "混元", "智谱", "minimax"],
}
#: Letters whose lower case is not what case folding compares.
_ODD = r"[ſı\u0307]"
#: What every version number holds.
_DOTTED = r"\p{Nd}\.\p{Nd}"


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case."""
    if pattern not in CORES:
        return text.rlike("(?iU)" + pattern)

    def likely(low: Column) -> Column:
        out = low.rlike(_DOTTED) if pattern == LOW_VALUE else low.rlike(_ODD)
        for core in CORES[pattern]:
            out = low.contains(core) | out
        return out

    # arrays of one element bind the text and its lower case, so that each is computed once
    return F.exists(F.array(text), lambda t: F.exists(F.array(F.lower(t)), likely) & t.rlike("(?iU)" + pattern))


def editorial_rules(title: Column, excerpt: Column, source_id: Column, role: Column, verified: Column) -> dict[str, Column]:
    """Name to condition under which the rule drops a candidate, in order."""
    text = F.concat(title, F.lit(" "), excerpt)
    high, concrete = has(text, HIGH_IMPACT), has(text, CONCRETE_IMPACT)
    return {
        "unverified_discovery": (role == "discovery") & ~verified,
        "sponsored": has(text, SPONSORED),
        "academic": has(text, ACADEMIC) & ~has(text, ACADEMIC_EXCEPTION),
        "always_low_value": has(text, ALWAYS_LOW_VALUE),
        "benchmark": has(text, BENCHMARK) & ~has(text, BENCHMARK_IMPACT),
        "minor_version": has(text, LOW_VALUE) & ~high,
        "developer": has(text, DEVELOPER) & ~(high & concrete),
        "code_release": source_id.startswith("github-") & has(text, GITHUB_RELEASE) & ~high,
        "corporate": has(text, CORPORATE) & ~concrete,
    }


def eligible(title: Column, excerpt: Column, source_id: Column, role: Column, verified: Column) -> Column:
    """Whether no editorial rule drops the candidate."""
    out = F.lit(True)
    for dropped in editorial_rules(title, excerpt, source_id, role, verified).values():
        out = out & ~dropped
    return out


def has_keyword(folded_title: Column) -> Column:
    """Whether a normalised, case-folded title announces something."""
    return folded_title.rlike("(?U)" + KEYWORDS)


def event_key(folded: Column, whole: bool = True) -> Column:
    """``action|terms`` of a normalised, case-folded title, or null.

    Terms are the sorted set of versioned products, without bare versions; or
    else the first two latin words that are no stop words, in order. A product
    with letters behind its version is none, unless ``whole`` is false: then it
    ends with the version, as in the SQL of the queries.
    """
    product = VERSIONED_PRODUCT if whole else VERSIONED_PRODUCT.removesuffix(NO_MORE)
    action = F.when(has(folded, EVENT_LAUNCH), "launch").when(has(folded, EVENT_PRICE), "price").when(folded.rlike("(?U)" + EVENT_UPDATE), "update")
    found = F.regexp_extract_all(folded, F.lit("(?iU)" + product), F.lit(1))
    products = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[\s_]+", "-"), r"^-+|-+$", ""))
    products = F.sort_array(F.array_distinct(F.filter(products, lambda x: ~x.rlike(r"^v\d+(?:\.\d+)*$"))))
    words = F.regexp_extract_all(folded, F.lit("(?iU)" + LATIN_TOKEN), F.lit(0))
    words = F.slice(F.filter(words, lambda x: ~x.isin(EVENT_STOPWORDS)), 1, 2)
    terms = F.when(F.size(products) > 0, products).otherwise(words)
    return F.when(action.isNotNull() & (F.size(terms) > 0), F.concat(action, F.lit("|"), F.array_join(terms, "|")))


def is_topic(text: Column) -> Column:
    return has(text, TOPIC)


def redact(text: Column) -> Column:
    """Credential-shaped text replaced by a mark."""
    return F.regexp_replace(text, "(?i)" + SECRETS, "[REDACTED]")


def has_secret(text: Column) -> Column:
    return text.rlike("(?i)" + SECRETS)
