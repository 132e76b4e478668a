"""Page types: an ordered cascade as one CASE over the facts of a page, whose tests are patterns over path, route, title and body."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import DATE

# Route words (a segment that begins with one), title words, body phrases, route patterns.
ROUTES = {
    "login": ("login", "signin", "sign-in", "auth",),
    "search": ("search", "query", "检索", "搜索",),
    "notice": ("notice", "announcement", "inform", "tzgg",),
    "news": ("news", "newsstatus", "media", "conference", "dynamic", "act", "activity", "activities", "event", "events", "xw", "djgh",),
    "product": ("product", "products", "jjfa", "solution", "case", "cases", "apply", "application", "equipment", "intelligentequipment", "smartmine", "smartocean", "railwayequipment", "algorithmcenter", "digital", "internethospital", "brainai", "ctimageai", "industry", "achievement", "achievements", "service", "services", "system", "custom", "project",),
    "profile": ("about", "aboutinfo", "profile", "brief-introduction", "company", "culture", "honor", "history", "organization", "framework", "incubator", "overview", "vision", "cooperation", "collaboration", "alliance", "partner", "partners", "management", "team", "member", "introduction", "datesources",),
    "research": ("research", "strategic-research", "direction", "scientific", "yanfa", "platform", "achievement", "achievements", "result", "results", "outcome", "outcomes", "source", "sources", "technology", "technologies", "innovation", "project", "xmzj", "datesources",),
    "recruitment": ("recruit", "recruitment", "career", "job", "rczp",),
    "contact": ("contact", "connect", "lxwm", "message", "feedback", "joinus", "join",),
}
TITLES = {
    "login": ("login", "signin", "登录", "用户登录",),
    "search": ("search", "query", "检索", "搜索",),
    "notice": ("notice", "notices", "announcement", "announcements", "通知", "公告", "公示",),
    "product": ("product", "products", "产品", "解决方案", "应用方案", "智能装备", "产品服务", "行业应用", "落地案例", "企划咨询", "成为合作伙伴", "数据增值服务平台",),
    "profile": ("about", "关于我们", "机构简介", "院所简介", "机构介绍", "院所介绍", "公司介绍", "研究院概况", "机构概况", "公司简介", "企业文化", "公司荣誉", "荣誉资质", "发展历程", "组织架构", "专家团队", "研发团队", "技术团队", "团队介绍", "技术专家", "孵化空间", "人才理念", "人才培养", "管理团队", "成员单位", "联创中心", "材料大数据平台", "合作高校", "创新联盟", "研究合作", "核心价值观", "企业价值观", "使命愿景", "简介", "概况",),
    "research": ("研究方向", "研发方向", "研究成果", "科研成果", "技术成果", "成果转化", "工程转化", "研发平台", "研发中心", "研究中心", "技术中心", "技术服务", "共性技术事业部", "产业孵化", "高光谱", "超光谱", "技术知识", "技术原理",),
    "recruitment": ("recruit", "recruitment", "career", "招聘", "人才招聘", "招聘信息", "岗位",),
    "contact": ("contact", "connect", "联系方式", "联系我们", "联系",),
    "notice_word": ("notice", "announcement", "通知", "公告", "公示",),
    "news_word": ("news", "动态", "资讯",),
}
PRODUCT_PHRASES = ("技术成果类别", "成果类别", "应用技术成果", "研究成果简介", "产品简介")
ITEM_PHRASES = ("发布时间", "发布日期", "发表时间", "来源：", "来源:", "作者：", "作者:", "publish time", "published", "view count")
PATTERNS = {
    "shown": r"(?i)/(?:detail|article|show|view)(?:/|$)",
    "about": r"(?i)/about[_-]?info(?:/|$)",
    "archive": r"(?i)/archives?/\d+(?:\.[^/]*)?$",
    "item": r"(?i)/article-item-\d+(?:\.[^/]*)?$",
    "paged": r"(?i)/page-\d+-\d+(?:\.[^/]*)?$",
    "post": r"(?i)/post/\d+(?:\.[^/]*)?$",
    "dated_status": r"(?i)/newsstatus/(?:news|inform)/20\d{2}[-/]\d{1,2}[-/]\d{1,2}/\d+",
    "dated_page": r"(?i)/20\d{2}/\d{2,4}/[^/]+/page\.html?$",
    "dated_info": r"(?i)/[^/]+/info/20\d{2}/\d+\.html?$",
    "numeric": r"(?i)/(?:news|notice|new|product|products|jjfa)(?:/[^/]+)*/[^/]*\d[^/]*(?:\.(?:html?|htm))?$",
    "compound": r"(?i)/(?:apply|application|case|cases|service|solution)/[^/]*\d[^/]*[_-][^/]*$",
    "static": r"(?i)^/page\d+(?:\.[^/]*)?$",
    "query_static": r"(?i)(?:^|/)(?:page|pages)[_-]?\d+(?:/|$)",
    "strict_new": r"(?i)/new/[^/]*\d[^/]*\.(?:html?|htm)$",
    "strict_news": r"(?i)/(?:news|notice|new)/[^/]+/[^/]*\d[^/]*\.(?:html?|htm)$",
    "strict_product": r"(?i)/(?:product|products|jjfa)/[^/]*\d[^/]*\.(?:html?|htm)$",
    "list": r"(?i)/(?:list|index|act|activity|activities|event|events|news\d*|notice\d*|rczp\d*|xmzj\d*)(?:[-_]\d+)*(?:\.(?:html?|htm))?/?$",
    "query_list": r"(?i)(?:^|/)(?:en/)?(?:news|notice|article|job|recruitment|research)/?$",
}


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^a-z0-9\x{3400}-\x{9fff}]", "")


def route_segments(route: Column) -> Column:
    """Segments without their extension, whole and cut at - and _, letters and digits only."""
    raw = F.transform(F.filter(F.split(F.lower(route), "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"\.(?:html?|php|asp|aspx|jsp)$", ""))
    cut = F.flatten(F.transform(raw, lambda s: F.filter(F.split(s, "[-_]+"), lambda t: t != "")))
    return F.transform(F.concat(raw, cut), _squeezed)


def begins(parts: Column, words: tuple[str, ...]) -> Column:
    pattern = "^(?:" + "|".join(re.sub(r"[^a-z0-9㐀-鿿]", "", w) for w in words) + ")"
    return F.exists(parts, lambda s: s.rlike(pattern))


def title_says(title: Column, words: tuple[str, ...]) -> Column:
    """ASCII words between non-letters, others anywhere; titles over 120 characters say nothing."""
    low = F.lower(F.trim(title))
    ascii_, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    pattern = "|".join([f"(?<![a-z])(?:{'|'.join(ascii_)})(?![a-z])"] * bool(ascii_) + other)
    return (F.length(low) <= 120) & low.rlike(pattern)


def classified(facts: Column, url: Column, media_type: Column | None = None, routes: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """struct(page_type, confidence, evidence) of a page's facts. routes: (pattern, type, label); the longest pattern that fits a URL wins, the first of equals."""
    title, body, path, query_route = (F.coalesce(facts[c], F.lit("")) for c in ("title", "body", "path", "query_route"))
    listed, dated = F.coalesce(facts["list_like"], F.lit(False)), facts["published_micros"].isNotNull()
    route = F.when(query_route != "", F.concat(path, F.lit("/"), query_route)).otherwise(path)
    parts, path_parts = route_segments(route), route_segments(path)
    fits = {k: (query_route if k.startswith("query") else path).rlike(p) for k, p in PATTERNS.items()}
    has = {k: begins(parts, w) for k, w in ROUTES.items()}
    for k, w in TITLES.items():
        has[k] = has[k] | title_says(title, w) if k in has and k not in ("login", "search") else has.get(k)
    early = F.lower(F.substring(body, 1, 4000))
    has["product"] = has["product"] | early.rlike("|".join(PRODUCT_PHRASES)) | (fits["compound"] & begins(path_parts, ("apply", "application", "case", "cases", "service")))
    has["research"] = has["research"] | (begins(parts, ("resource",)) & ~listed)
    login = begins(path_parts, ROUTES["login"]) | title_says(title, TITLES["login"]) | F.coalesce(facts["login_form"], F.lit(False))
    search = begins(path_parts, ROUTES["search"]) | title_says(title, TITLES["search"])
    start = F.lower(F.substring(body, 1, 2000))
    item = dated & (F.length(body) >= 80) & (start.rlike("|".join(ITEM_PHRASES)) | ((F.regexp_count(start, F.lit(DATE)) == 1) & (F.length(body) >= 180)))
    topical = has["notice"] | has["news"] | has["product"] | has["profile"] | has["research"] | has["recruitment"] | has["contact"]
    explicit = fits["shown"] | fits["about"] | fits["archive"] | fits["item"] | fits["paged"] | fits["post"] | fits["dated_status"] | fits["dated_page"] | fits["dated_info"]
    strict = fits["strict_new"] | fits["strict_news"] | fits["strict_product"]
    detail = (
        explicit | fits["compound"] | (fits["static"] & (F.length(body) >= 180)) | fits["query_static"] | (item & ~topical)
        | (fits["numeric"] & (~listed | strict | item)) | F.coalesce(facts["query_detail"], F.lit(False))
    )
    many = listed | fits["list"] | fits["query_list"]
    full = dated & (F.length(body) >= 120)
    out = F.lit(None)

    def verdict(kind: str, confidence: float, *evidence: Column | str) -> Column:
        said = F.array(*[e if isinstance(e, Column) else F.lit(e) for e in evidence])
        return F.struct(F.lit(kind).alias("page_type"), F.lit(confidence).alias("confidence"), said.alias("evidence"))

    cascade: list[tuple[Column, Column]] = []
    for pattern, kind, label in sorted(routes, key=lambda r: -len(r[0])):
        cascade.append((url.rlike(f"(?i){pattern}"), verdict(kind, 0.95, f"route_pattern:{label or pattern}")))
    if media_type is not None:
        media = F.coalesce(media_type, F.lit(""))
        cascade.append(((media != "") & ~F.lower(media).rlike("^(?:text/html|application/xhtml)"), verdict("attachment", 0.98, F.concat(F.lit("media_type:"), media))))
    cascade += [
        (path.isin("", "/") & (query_route == ""), verdict("home", 0.99, "root_path")),
        (login, verdict("login", 0.94, "login_route_or_form")),
        (search, verdict("search", 0.9, "search_route_or_title")),
    ]
    for kind, confidence in (("notice", 0.9), ("product", 0.88), ("profile", 0.88), ("research", 0.88), ("recruitment", 0.88)):
        cascade.append((detail & has[kind], verdict(kind, confidence, "detail_route", f"{kind}_route")))
    cascade += [
        (detail, verdict("article", 0.8, "detail_route")),
        (has["notice"] & many, verdict("notice_list", 0.86, "notice_route", "list_links")),
        (has["notice"], verdict("notice", 0.78, "notice_route")),
        (has["news"] & many, verdict("news_list", 0.86, "news_route", "list_links")),
        (has["news"] & full, verdict("article", 0.76, "news_route", "published_date", "substantial_body")),
        (has["news"], verdict("article", 0.68, "news_route")),
    ]
    cascade += [(has[k], verdict(k, c, f"{k}_route")) for k, c in (("product", 0.82), ("profile", 0.82), ("research", 0.82), ("recruitment", 0.82), ("contact", 0.9))]
    cascade += [
        (many, verdict("list", 0.72, "link_density")),
        (full, verdict("article", 0.76, "published_date", "substantial_body")),
        (title_says(title, TITLES["notice_word"]), verdict("notice", 0.7, "title_keyword:notice")),
        (title_says(title, TITLES["news_word"]), verdict("article", 0.65, "title_keyword:news")),
    ]
    out = verdict("other", 0.35, "no_specific_signal")
    for test, value in reversed(cascade):
        out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
    return out
