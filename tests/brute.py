"""Straight-line reimplementations on small lists, used as expected values."""

from __future__ import annotations

import math
import statistics


def minus(a, b):
    return None if a is None or b is None else a - b


def divide(a, b):
    return None if a is None or b is None or b == 0 else a / b


def distance(a, b):
    if None in (*a, *b):
        return None
    (la1, lo1), (la2, lo2) = [[math.radians(x) for x in p] for p in (a, b)]
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def flight_features(rows):
    """Derived features of one flight; rows are dicts sorted by row_idx with t in seconds."""
    out = []
    for i, row in enumerate(rows):
        prev = rows[i - 1] if i else None
        f = {}
        dt = minus(row["t"], prev["t"]) if prev else None
        f["dt_s"] = None if dt is None else min(dt, 3600.0)
        f["ts_gap_flag"] = int(dt is not None and dt > 60)
        get = (lambda c, p=prev: p[c] if p else None)
        f["d_lat_deg"] = minus(row["latitude"], get("latitude"))
        f["d_lon_deg"] = minus(row["longitude"], get("longitude"))
        f["d_alt_m"] = minus(row["altitude"], get("altitude"))
        f["dist_m"] = distance((get("latitude"), get("longitude")), (row["latitude"], row["longitude"]))
        f["speed_gps_mps"] = divide(f["dist_m"], dt)
        f["speed_resid_mps"] = minus(row["speed"], f["speed_gps_mps"])
        f["accel_mps2"] = divide(minus(row["speed"], get("speed")), dt)
        f["alt_rate_mps"] = divide(f["d_alt_m"], dt)
        turn = minus(row["heading"], get("heading"))
        f["d_heading_deg"] = None if turn is None else (turn + 540.0) % 360.0 - 180.0
        f["row_frac"] = divide(row["row_idx"], rows[-1]["row_idx"])
        for c in ("altitude", "speed", "latitude", "longitude"):
            seen = [r[c] for r in rows[max(0, i - 9) : i + 1] if r[c] is not None]
            mean = sum(seen) / len(seen) if seen else None
            f[f"roll_dev_{c}"] = minus(row[c], mean)
            f[f"roll_std_{c}"] = statistics.stdev(seen) if len(seen) > 1 else None
        out.append(f)
    return out


def quantile(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = (len(values) - 1) * share
    low = math.floor(at)
    high = math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


def centre_scale(values):
    values = [v for v in values if v is not None]
    if not values:
        return None, None
    median = quantile(values, 0.5)
    scale = quantile([abs(v - median) for v in values], 0.5) * 1.4826
    if scale < 1e-6:
        std = statistics.stdev(values) if len(values) > 1 else 0.0
        scale = std if std > 1e-6 else None
    return median, scale


def average_precision(labels, scores):
    total, hits, seen, out = sum(labels), 0, 0, 0.0
    for value in sorted(set(scores), reverse=True):
        here = [y for y, s in zip(labels, scores) if s == value]
        hits, seen = hits + sum(here), seen + len(here)
        out += sum(here) / total * hits / seen
    return out


def roc_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def best_threshold(labels, scores):
    best, best_f1 = None, -1.0
    for value in sorted(set(scores)):
        tp = sum(1 for y, s in zip(labels, scores) if s >= value and y)
        flagged = sum(1 for s in scores if s >= value)
        precision, recall = tp / flagged, tp / sum(labels)
        f1 = 2 * precision * recall / (precision + recall + 1e-12)
        if f1 > best_f1:
            best, best_f1 = value, f1
    return best
