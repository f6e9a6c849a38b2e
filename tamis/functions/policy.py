"""Decision rules as expressions: penalties, thresholds, levels. Levels are 0 safe, 1 blur, 2 ban."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
NSFW_BAN, NSFW_BLUR = 0.90, 0.80
VIOLENCE_BAN, VIOLENCE_BLUR = 0.90, 0.70
VIDEO_NSFW_BAN, VIDEO_NSFW_BLUR = 0.80, 0.70
VIOLENCE_CUT, SPORT_CUT = 0.50, 0.65
RESOLUTION = [(144 * 176, 0.20), (360 * 480, 0.12), (640 * 480, 0.08)]
PENALTIES = {"anime": 0.15, "dark": 0.12, "warm": 0.10, "composite": 0.20, "sport": 0.15}
HIGH_SCORE, HIGH_FRAMES = 0.7, 6


def margin_penalty(p: Column, q: Column) -> Column:
    """Less 0.2 if p leads q by under 0.4 and is under 0.95."""
    return F.when((p - q < 0.4) & (p < 0.95), F.greatest(F.lit(0.0), p - 0.2)).otherwise(p)


def level(score: Column, ban: float, blur: float) -> Column:
    return F.when(score >= ban, 2).when(score >= blur, 1).otherwise(0)


def action(of_level: Column) -> Column:
    return F.when(of_level == 2, "ban").when(of_level == 1, "blur").otherwise("safe")


def image_level(nsfw: Column, violence: Column) -> Column:
    return F.greatest(level(nsfw, NSFW_BAN, NSFW_BLUR), level(violence, VIOLENCE_BAN, VIOLENCE_BLUR))


def resolution_penalty(width: Column, height: Column) -> Column:
    case = F.lit(0.0)
    for pixels, penalty in reversed(RESOLUTION):
        case = F.when(width * height <= pixels, penalty).otherwise(case)
    return case


def penalised(peak: Column, resolution: Column, **flags: Column) -> Column:
    """The peak after all penalties that apply, never below 0: each step is cut off at 0."""
    value = F.greatest(F.lit(0.0), peak - resolution)
    for name, penalty in PENALTIES.items():
        if name in flags:
            value = F.greatest(F.lit(0.0), value - F.when(flags[name], penalty).otherwise(0.0))
    return value


def with_bypass(peak: Column, after: Column, high_frames: Column, dark: Column, warm: Column, composite: Column) -> Column:
    """The raw peak again, where many frames are high and one of these three penalties was applied."""
    return F.when((high_frames >= HIGH_FRAMES) & (dark | warm | composite), peak).otherwise(after)


def violence_action(score: Column, sport: Column, anime: Column, gore: Column) -> Column:
    over = score >= F.when(sport, SPORT_CUT).otherwise(VIOLENCE_CUT)
    return F.when(over & ~sport & anime, "blur").when(over & ~sport & gore, "ban").when(over & ~sport, "blur").otherwise("safe")


def video_decision(peak: Column, nsfw: Column, high_frames: Column, resolution: Column, p_sports: Column, anime: Column, gore: Column, dark: Column, warm: Column, composite: Column) -> dict[str, Column]:
    """What a video's peaks come to. The violence peak less all penalties, or the raw one if many frames are high and a
    penalty for light, colour or composition was applied; its action depends on the context. The nsfw peak is lowered for
    sport alone. flagged is true if either action isn't safe."""
    sport = p_sports > SPORTS_CUT
    after = penalised(peak, resolution, anime=anime, dark=dark, warm=warm, composite=composite, sport=sport)
    score = with_bypass(peak, after, high_frames, dark, warm, composite)
    nsfw_score = F.when(sport, nsfw_after_sport(nsfw, p_sports)).otherwise(nsfw)
    violence = violence_action(score, sport, anime, gore)
    other = action(level(nsfw_score, VIDEO_NSFW_BAN, VIDEO_NSFW_BLUR))
    return {"violence_score": score, "nsfw_score": nsfw_score, "violence": violence, "nsfw": other, "flagged": (violence != "safe") | (other != "safe")}


def ensemble_self_harm(vit: Column, clip: Column, yolo: Column, cnn: Column) -> Column:
    return 0.5 * F.greatest(vit, 0.8 * clip) + 0.3 * yolo + 0.2 * cnn


def fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp), F.lit(0.0))


# Fixed values of the detector and context rules.
DETECTOR_SCORE, BREAST_SCORE = 0.90, 0.80
BREAST_CLASSES = ("FEMALE_BREAST_EXPOSED", "MALE_BREAST_EXPOSED")
BAN_CLASSES = ("FEMALE_GENITALIA_EXPOSED", "MALE_GENITALIA_EXPOSED", "ANUS_EXPOSED")
BAN_TERMS = ("pussy", "vagina", "genitalia")
SPORTS_CUT, ANIME_CUT, GORE_CUT, BRAWL_CUT, LEAST_FACTOR = 0.55, 0.55, 0.60, 0.22, 0.15
SPORTS_SHARPNESS, GORE_SHARPNESS = 20, 25
REASONS = {"nsfw": ("nhạy cảm / sexy / bikini", "khỏa thân / khiêu dâm"), "violence": ("bạo lực nhẹ", "bạo lực")}
REASON_HEADS = ("Nội dung có yếu tố: ", "Phát hiện nội dung: ")


def body_trigger(boxes: Column, exact: bool = False) -> Column:
    """Whether a box (cls, conf) calls for a ban: by parts of the class name in any case, or by exact class names."""
    if exact:
        hit = lambda b: b["cls"].isin(*BAN_CLASSES) | (b["cls"].isin(*BREAST_CLASSES) & (b["conf"] >= BREAST_SCORE))
    else:
        hit = lambda b: F.lower(b["cls"]).rlike("|".join(BAN_TERMS)) | (F.contains(F.lower(b["cls"]), F.lit("breast")) & (b["conf"] >= BREAST_SCORE))
    return F.coalesce(F.exists(boxes, hit), F.lit(False))


def detector_override(score: Column, base: Column, trigger: Column) -> Column:
    """For scores that call the detector, its boxes alone decide between ban and blur."""
    return F.when(score >= DETECTOR_SCORE, F.when(trigger, "ban").otherwise("blur")).otherwise(base)


def class_confidence(boxes: Column, cls: Column) -> Column:
    """The highest confidence among the boxes of a class; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter(boxes, lambda b: b["cls"] == cls), lambda b: b["conf"])), F.lit(0.0))


def of_two(a: Column, b: Column, sharpness: float) -> Column:
    """Softmax share of the first of two similarities."""
    return 1 / (1 + F.exp((b - a) * sharpness))


def sports_probability(sports: Column, violence: Column) -> Column:
    return of_two(sports, violence, SPORTS_SHARPNESS)


def suppress_factor(p_sports: Column) -> Column:
    return F.when(p_sports > SPORTS_CUT, F.greatest(F.lit(LEAST_FACTOR), 1 - p_sports)).otherwise(1.0)


def context_flags(sports: Column, violence: Column, anime: Column, gore: Column, brawl: Column) -> dict[str, Column]:
    """Flags from mean similarities to the prompt groups, and the factor for violence scores."""
    p = sports_probability(sports, violence)
    return {
        "is_sports": p > SPORTS_CUT,
        "is_anime": of_two(anime, (sports + violence) / 2, SPORTS_SHARPNESS) > ANIME_CUT,
        "is_gore": of_two(gore, brawl, GORE_SHARPNESS) > GORE_CUT,
        "is_brawl": brawl > BRAWL_CUT,
        "factor": suppress_factor(p),
    }


def nsfw_after_sport(score: Column, p_sports: Column) -> Column:
    """Less what sport suppresses, to two digits; never below 0."""
    return F.greatest(F.lit(0.0), score - F.round(1 - suppress_factor(p_sports), 2))


def image_reason(nsfw: Column, violence: Column) -> Column:
    """The text for an image's levels; empty at level 0."""
    parts = [F.when(lv == 2, REASONS[k][1]).when(lv == 1, REASONS[k][0]) for k, lv in (("nsfw", nsfw), ("violence", violence))]
    top = F.greatest(nsfw, violence)
    head = F.when(top == 2, REASON_HEADS[1]).when(top == 1, REASON_HEADS[0])
    return F.when(top > 0, F.concat(head, F.concat_ws(", ", *parts))).otherwise("")


def ensemble_weapon(yolo: Column, gore: Column) -> Column:
    return F.greatest(yolo, 0.5 * gore)


def with_classes(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Adds class, category, priority, blur and ban by class_id; classes the taxonomy lacks are named after their id
    and have no thresholds. The taxonomy is a short table by its nature; the optimiser sees its size."""
    joined = rows.join(taxonomy, "class_id", "left")
    return joined.withColumns({"class": F.coalesce("class", F.concat(F.lit("unknown_"), F.col("class_id").cast("string"))), "category": F.coalesce("category", F.lit("unknown")), "priority": F.coalesce("priority", F.lit(0))})


def rolled_up(found: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per item and policy category: the highest score, whether any scene is over its class's blur threshold, the
    action, and the highest priority. `found`: item, class_id, p."""
    rows = with_classes(found, taxonomy)
    over = lambda c: F.coalesce(F.bool_or(F.col("p") >= F.col(c)), F.lit(False))
    out = rows.groupBy("item", "category").agg(F.max("p").alias("p"), over("blur").alias("any_blur"), over("ban").alias("_ban"), F.max("priority").alias("priority"))
    return out.withColumn("action", F.when(F.col("_ban"), "ban").when(F.col("any_blur"), "blur").otherwise("safe")).drop("_ban")


def verdict_level(verdict: Column) -> Column:
    """2 if the verdict's text says BAN, 1 if it says BLUR, else 0."""
    return F.when(F.contains(verdict, F.lit("BAN")), 2).when(F.contains(verdict, F.lit("BLUR")), 1).otherwise(0)


def stated_reason(text: Column) -> Column:
    """What follows 'Reason:' and its decoration; empty without it."""
    return F.regexp_extract(text, "Reason:[* ]*(.*)$", 1)


def highest_by_category(rows: DataFrame, item: str, scores: dict[str, str], ban: float, blur: float) -> DataFrame:
    """Per item and category (category -> column of scores): the highest score and its action."""
    entries = F.array(*(F.struct(F.lit(k).alias("category"), F.col(c).alias("p")) for k, c in scores.items()))
    found = rows.select(item, F.explode(entries).alias("e")).groupBy(item, "e.category").agg(F.max("e.p").alias("p"))
    return found.withColumn("action", action(level(F.col("p"), ban, blur)))


def flags(label: Column, score: Column, cuts: dict[str, float], default: float) -> Column:
    """Whether a score reaches its label's cut."""
    known = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))
    return score >= F.coalesce(F.try_element_at(known, label), F.lit(default))


def priorities(rows: DataFrame, item: str, of_level: dict[int, int], default: int = 0) -> DataFrame:
    """The highest priority among an item's levels; levels without one have the default."""
    known = F.create_map(*(F.lit(x) for pair in of_level.items() for x in pair))
    return rows.groupBy(item).agg(F.max(F.coalesce(F.try_element_at(known, F.col("level")), F.lit(default))).alias("priority"))
