"""Social profiles in page markup, and what they say about a business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contacts import join_url
from .presence import nullify
from .text import business_slug, domain_label

# Fixed values -------------------------------------------------------------------
PLATFORM_LINKS = {
    "facebook": (
        r"(?:https?:)?\/\/(?:www\.)?facebook\.com\/([a-zA-Z0-9.]+)",
        r"(?:https?:)?\/\/(?:www\.)?fb\.com\/([a-zA-Z0-9.]+)",
    ),
    "instagram": (
        r"(?:https?:)?\/\/(?:www\.)?instagram\.com\/([a-zA-Z0-9._]+)",
        r"(?:https?:)?\/\/(?:www\.)?instagr\.am\/([a-zA-Z0-9._]+)",
    ),
    "twitter": (
        r"(?:https?:)?\/\/(?:www\.)?twitter\.com\/([a-zA-Z0-9_]+)",
        r"(?:https?:)?\/\/(?:www\.)?x\.com\/([a-zA-Z0-9_]+)",
    ),
    "linkedin": (
        r"(?:https?:)?\/\/(?:www\.)?linkedin\.com\/(?:company|in)\/([a-zA-Z0-9-]+)",
        r"(?:https?:)?\/\/(?:www\.)?linkedin\.com\/school\/([a-zA-Z0-9-]+)",
    ),
    "youtube": (
        r"(?:https?:)?\/\/(?:www\.)?youtube\.com\/(?:c|channel|user)\/([a-zA-Z0-9-]+)",
        r"(?:https?:)?\/\/(?:www\.)?youtu\.be\/([a-zA-Z0-9-]+)",
    ),
    "yelp": (
        r"(?:https?:)?\/\/(?:www\.)?yelp\.com\/biz\/([a-zA-Z0-9-]+)",
        r"(?:https?:)?\/\/(?:www\.)?yelp\.ca\/biz\/([a-zA-Z0-9-]+)",
    ),
    "pinterest": (
        r"(?:https?:)?\/\/(?:www\.)?pinterest\.com\/([a-zA-Z0-9_]+)",
        r"(?:https?:)?\/\/(?:www\.)?pin\.it\/([a-zA-Z0-9_]+)",
    ),
    "tiktok": (
        r"(?:https?:)?\/\/(?:www\.)?tiktok\.com\/@([a-zA-Z0-9_.]+)",
        r"(?:https?:)?\/\/(?:www\.)?tiktok\.com\/([a-zA-Z0-9_.]+)",
    ),
    "snapchat": (r"(?:https?:)?\/\/(?:www\.)?snapchat\.com\/add\/([a-zA-Z0-9_.]+)",),
    "reddit": (r"(?:https?:)?\/\/(?:www\.)?reddit\.com\/(?:r|user)\/([a-zA-Z0-9_]+)",),
    "medium": (r"(?:https?:)?\/\/(?:www\.)?medium\.com\/@([a-zA-Z0-9.]+)",),
}
META_MARK = "al:"
# A class name stands for its longer spellings too, as it is matched as a substring.
ICON_CLASSES = {
    "facebook": ("fa-facebook", "icon-facebook"),
    "twitter": ("fa-twitter", "icon-twitter"),
    "instagram": ("fa-instagram", "icon-instagram"),
    "linkedin": ("fa-linkedin", "icon-linkedin"),
    "youtube": ("fa-youtube", "icon-youtube"),
    "pinterest": ("fa-pinterest", "icon-pinterest"),
    "tiktok": ("fa-tiktok",),
    "snapchat": ("fa-snapchat",),
    "yelp": ("fa-yelp",),
}
PLATFORM_WEIGHTS = {
    "instagram": 10, "facebook": 8, "twitter": 7, "linkedin": 6,
    "youtube": 9, "tiktok": 9, "pinterest": 5, "yelp": 4,
}
OTHER_WEIGHT, SCORE_FACTOR, SCORE_CAP = 5, 3, 100
PROFILE_URLS = (
    ("facebook", "https://facebook.com/", "name"),
    ("facebook", "https://facebook.com/", "domain"),
    ("facebook", "https://fb.com/", "name"),
    ("instagram", "https://instagram.com/", "name"),
    ("instagram", "https://instagram.com/", "domain"),
    ("twitter", "https://twitter.com/", "name"),
    ("twitter", "https://twitter.com/", "domain"),
    ("twitter", "https://x.com/", "name"),
    ("linkedin", "https://linkedin.com/company/", "name"),
    ("linkedin", "https://linkedin.com/company/", "domain"),
    ("youtube", "https://youtube.com/c/", "name"),
    ("youtube", "https://youtube.com/channel/", "name"),
)
ADVICE = {
    "instagram": "Consider creating an Instagram account for visual marketing",
    "facebook": "Facebook presence would help with local community engagement",
    "linkedin": "LinkedIn is crucial for B2B networking",
    "youtube": "Video content on YouTube could showcase products/services",
}
# --------------------------------------------------------------------------------


def _without_nulls(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _first_like(values: Column, pattern: str) -> Column:
    return F.get(F.filter(values, lambda v: v.rlike(pattern)), 0)


def linked_profiles(links: Column, platforms=PLATFORM_LINKS) -> Column:
    """Platform -> first of a page's links (``html.hrefs``) that leads there."""
    found = []
    for platform, patterns in platforms.items():
        firsts = [_first_like(links, p) for p in patterns]
        found.append((platform, F.coalesce(*firsts)))
    return _without_nulls(found)


def mentions_icon(low: Column) -> Column:
    """Cheap test on the lower-case page before anchors are searched for icons."""
    return low.contains("fa-") | low.contains("icon-")


def icon_profiles(anchors: Column, page_url: Column) -> Column:
    """Platform -> target of the first anchor that wraps the platform's icon."""
    found = []
    for platform, classes in ICON_CLASSES.items():
        options = []
        for cls in classes:
            wraps = _first_like(anchors, f'(?is)class="[^"]*{cls}')
            href = nullify(F.regexp_extract(wraps, r'(?is)href\s*=\s*"([^"]*)"', 1))
            options.append(join_url(page_url, href))
        found.append((platform, F.coalesce(*options)))
    return _without_nulls(found)


def meta_profile(clean: Column) -> Column:
    """The first ``al:<platform>:url`` tag, as a map of at most one entry."""
    options = []
    for platform in PLATFORM_LINKS:
        tag = nullify(F.regexp_extract(clean, f'(?is)<meta\\s[^>]*property="al:{platform}:url"[^>]*>', 0))
        content = F.regexp_extract(tag, r'(?is)content="([^"]*)"', 1)
        options.append(F.when(tag.isNotNull(), F.create_map(F.lit(platform), content)))
    return F.coalesce(*options, F.create_map().cast("map<string,string>"))


def profile_candidates(name: Column, website: Column) -> Column:
    """Likely profile URLs as array(struct(platform, url)); empty without both inputs."""
    parts = {"name": business_slug(name), "domain": domain_label(website)}
    urls = F.array(
        *[F.struct(F.lit(p).alias("platform"), F.concat(F.lit(u), parts[which]).alias("url")) for p, u, which in PROFILE_URLS]
    )
    return F.when((name != "") & (website != ""), urls)


def social_score(profiles: Column) -> Column:
    """Weighted platform count, capped at 100."""
    weights = F.create_map(*[F.lit(x) for kv in PLATFORM_WEIGHTS.items() for x in kv])
    total = F.aggregate(
        F.map_keys(profiles),
        F.lit(0),
        lambda a, p: a + F.coalesce(F.try_element_at(weights, p), F.lit(OTHER_WEIGHT)),
    )
    return F.least(F.lit(SCORE_CAP), total * SCORE_FACTOR)


def missing_platforms(profiles: Column) -> Column:
    """The platforms worth advising that a business lacks."""
    return F.array_except(F.array(*[F.lit(p) for p in ADVICE]), F.map_keys(profiles))


def advice(profiles: Column) -> Column:
    """Recommendations; the LinkedIn one only if the profiles mention B2B."""
    lacks = missing_platforms(profiles)
    mentions_b2b = F.exists(
        F.concat(F.map_keys(profiles), F.map_values(profiles)), lambda t: F.coalesce(t.contains("B2B"), F.lit(False))
    )
    lines = []
    for platform, line in ADVICE.items():
        wanted = F.array_contains(lacks, platform)
        lines.append(F.when(wanted & mentions_b2b if platform == "linkedin" else wanted, F.lit(line)))
    return F.array_compact(F.array(*lines))
