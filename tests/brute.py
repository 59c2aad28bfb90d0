"""Plain single-machine answers the distributed operators are checked against."""


def iou(a, b):
    wide = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    high = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = wide * high
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def box_match(preds, gts, thr=0.5):
    """preds [(idx, box, score)], gts [(idx, box)] -> {pred idx: gt idx or None}."""
    free, out = dict(gts), {}
    for i, box, _ in sorted(preds, key=lambda p: (-p[2], p[0])):
        fits = [(iou(box, g), j) for j, g in free.items() if iou(box, g) >= thr]
        out[i] = max(fits)[1] if fits else None
        if fits:
            free.pop(out[i])
    return out


def suppress(boxes, thr=0.5):
    kept = []
    for i, box, _ in sorted(boxes, key=lambda p: (-p[2], p[0])):
        if all(iou(box, k) < thr for _, k in kept):
            kept.append((i, box))
    return {i for i, _ in kept}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text_match(gts, preds):
    """[(idx, norm)] each -> {gt idx: pred idx or None}."""
    free, out = dict(preds), {}
    for i, g in sorted(gts):
        out[i] = min(free, key=lambda j: (edit(g, free[j]), j)) if free else None
        free.pop(out[i], None)
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def average_precision(marks, n_gt):
    """marks in curve order, 0/1 each."""
    points, tp = [], 0
    for n, hit in enumerate(marks, 1):
        tp += hit
        points.append((tp / n_gt, tp / n))
    total, before = 0.0, 0.0
    for at, (rec, _) in enumerate(points):
        total += (rec - before) * max(p for _, p in points[at:])
        before = rec
    return total
