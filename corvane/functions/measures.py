"""Column functions on distances, boxes, angles and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths in metres.
STEP_METRES, FOOT_METRES = 0.6, 0.3048
# Phrases that make a stated distance uncertain, inexact, relative, or no distance.
UNCERTAIN = "uncertain|uncertaint(?:y|ies)|possibly|maybe|might\\s+be|could\\s+be|unknown|unclear|perhaps|probable|probably|estimated|estimate|guess|guessed|ambiguous|likely|unlikely|apparently|seemingly"
INEXACT = "at\\s+least|at\\s+most|(?:no\\s+)?less\\s+than|(?:no\\s+)?more\\s+than|greater\\s+than|over|up\\s+to|farther|further|closer|nearer|minimum|maximum|or\\s+more|or\\s+less"
RELATIVE = "behind|ahead\\s+of|in(?:\\s+|-)front(?:\\s+|-)of|above|below|off\\s+the\\s+ground|adjacent|nearby|near|(?:to\\s+the\\s+)?(?:left|right)\\s+of|from|within|same\\s+as|same\\s+distance|co[- ]located|next\\s+to|beside|under(?:neath)?|relative\\s+to|to\\s+its?"
NO_DISTANCE = "walk|move|turn|go|wide|width|tall|height|high|long|length|deep|depth"
# Fixed value: units of a stated distance.
UNITS = "steps?|meters?|metres?|feet|foot"
# Labels of bearings, from right to left, and the mirror image of each.
DIRECTIONS = ("right", "right_ahead", "slightly_right_ahead", "ahead", "slightly_left_ahead", "left_ahead", "left")
MIRRORED = dict(zip(DIRECTIONS, reversed(DIRECTIONS), strict=True))

_NUMBER = r"\d+(?:\.\d+)?"
_STATED = rf"(?i)\b(?:between\s+)?({_NUMBER})\s*(?:(?:-|to|and)\s*({_NUMBER})\s*)?({UNITS})\b"


def distance_bin(steps: Column) -> Column:
    """Near to 5 steps, Medium to 8, then Far; Unknown without a number."""
    return F.when(steps.isNull(), "Unknown").when(steps <= 5, "Near").when(steps <= 8, "Medium").otherwise("Far")


def prompt_distance_bin(steps: Column) -> Column:
    """near below 10 steps, medium to 15, then far."""
    return F.when(steps < 10, "near").when(steps <= 15, "medium").when(steps > 15, "far")


def post_hoc_distance_bin(steps: Column) -> Column:
    """near to 5 steps, medium to 8, then far."""
    return F.when(steps <= 5, "near").when(steps <= 8, "medium").when(steps > 8, "far")


def stated_steps(text: Column) -> Column:
    """The steps that a text states: its only phrase of a number or range with a unit, or null."""
    low, high = F.regexp_extract(text, _STATED, 1), F.regexp_extract(text, _STATED, 2)
    unit = F.lower(F.regexp_extract(text, _STATED, 3))
    numbers = F.regexp_count(text, F.lit(rf"\b{_NUMBER}\b"))
    low_n, high_n = low.try_cast("double"), high.try_cast("double")
    value = F.when(high_n.isNull(), low_n).otherwise((low_n + high_n) / 2)
    steps = F.when(unit.rlike("^met"), value / STEP_METRES).when(unit.isin("foot", "feet"), value * FOOT_METRES / STEP_METRES).otherwise(value)
    one = (F.regexp_count(text, F.lit(_STATED)) == 1) & (numbers == F.when(high_n.isNull(), 1).otherwise(2)) & (high_n.isNull() | (high_n >= low_n))
    return F.when(one, F.floor(steps + 0.5).cast("int"))


def distance_provenance(steps: Column, text: Column) -> Column:
    """unknown without steps, direct_numeric where the text states just these, else derived_reviewed."""
    word = lambda phrases: rf"(?i)\b(?:{phrases})\b"
    without_range = F.regexp_replace(text, rf"(?i)\bfrom\s+{_NUMBER}\s+to\s+{_NUMBER}\s+(?:{UNITS})\b", "")
    derived = text.isNull() | text.rlike(word(UNCERTAIN)) | text.rlike(word(INEXACT)) | text.rlike("[<>]") | without_range.rlike(word(RELATIVE)) | text.rlike(r"(?i)\baround\b(?!\s*\d)") | text.rlike(word(NO_DISTANCE))
    return F.when(steps.isNull(), "unknown").when(derived, "derived_reviewed").when(stated_steps(text) == steps, "direct_numeric").otherwise("derived_reviewed")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), or 0 without any."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 if either is empty."""
    inner = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda box: F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    return F.when((area(a) <= 0) | (area(b) <= 0), 0.0).otherwise(F.coalesce(F.try_divide(inner, area(a) + area(b) - inner), F.lit(0.0)))


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Pixel corners of a normalised centre box."""
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def box_is_valid(cx: Column, cy: Column, w: Column, h: Column, slack: float = 1e-6) -> Column:
    inside = (cx - w / 2 >= -slack) & (cy - h / 2 >= -slack) & (cx + w / 2 <= 1 + slack) & (cy + h / 2 <= 1 + slack)
    return (w > 0) & (h > 0) & inside


def half_away(value: Column) -> Column:
    """Rounded to whole numbers, halves away from zero."""
    return F.round(value, 0)


def direction_degrees(x: Column, width: Column) -> Column:
    """90 at the left border of an image to -90 at the right; 0 for a width of one."""
    return F.when(width <= 1, 0.0).otherwise(90 - F.try_divide(180 * x, width - 1))


def from_bottom(y: Column, height: Column) -> Column:
    return height - 1 - y


def from_bottom_clamped(y: Column, height: Column) -> Column:
    return F.greatest(F.lit(0), F.least(height - 1, height - y))


def depth_steps(depth: Column) -> Column:
    """Steps for an 8-bit depth above 0, the nearest 255; null outside."""
    return F.when((depth > 0) & (depth <= 255), F.round(3.876 + 5.197 * (F.ln(F.lit(255.0)) - F.ln(depth)), 0).cast("int"))


def bearing(x: Column, z: Column) -> Column:
    """Degrees to the left of straight ahead, of a point at x to the right and z in front."""
    return F.degrees(F.atan2(-x, z))


def back_off(attempt: Column) -> Column:
    """Seconds to wait after an attempt, from 0.25 doubling to 2."""
    return F.least(F.lit(2.0), 0.25 * F.pow(F.lit(2.0), attempt - 1))


def fits_context(prompt_tokens: Column, new_tokens: Column, context: int) -> Column:
    return (prompt_tokens > 0) & (new_tokens > 0) & (prompt_tokens + new_tokens <= context)


Vector = tuple[Column, Column, Column]
#: Below this square of its horizontal distance a point is at the camera's feet, and its direction counts as 0.
NEAR_FOOT = 0.01


def turned(forward: Vector, to: Vector) -> Column:
    """Degrees to the left, within the horizontal plane (y is up), from the forward direction to a point; 0 at the camera's feet, -180 straight behind."""
    across, along = forward[2] * to[0] - forward[0] * to[2], forward[0] * to[0] + forward[2] * to[2]
    return F.when(to[0] * to[0] + to[2] * to[2] < NEAR_FOOT, 0.0).otherwise(-F.degrees(F.atan2(across + 0.0, along)))


def seen(camera: Vector, forward: Vector, position: Vector, closest: Vector, active: Column, *, half_angle: float, most_distance: float, inactive: bool = False) -> Column:
    """struct(seen, direction, distance) of an object at a position, with the point of it that is closest to the camera.

    It must be active (unless inactive ones count), in front, in the sector of
    half_angle on either side or at the camera's feet, near enough in space, and
    its closest point in front of the image plane.  Direction and distance are
    those of the closest point.  A null fails.
    """
    less = lambda p: tuple(a - b for a, b in zip(p, camera, strict=True))
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    to, near = less(position), less(closest)
    sector = (to[0] * to[0] + to[2] * to[2] < NEAR_FOOT) | (F.abs(turned(forward, to)) <= half_angle)
    ok = (active | F.lit(inactive)) & (dot(forward, to) > 0) & sector & (F.sqrt(dot(to, to)) <= most_distance) & (dot(forward, near) > 0)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("seen"), turned(forward, near).alias("direction"), F.sqrt(dot(near, near)).alias("distance"))


# What red, green and blue add to brightness.
BRIGHTNESS = (0.299, 0.587, 0.114)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """The brightness of an image from the flat arrays of its channels."""
    mixed = F.zip_with(red, green, lambda r, g: BRIGHTNESS[0] * r + BRIGHTNESS[1] * g)
    return F.zip_with(mixed, blue, lambda x, b: x + BRIGHTNESS[2] * b)
