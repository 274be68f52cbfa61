"""Operator 2: planted copies are found, other images are left alone, odd images don't fail."""

from collections import defaultdict

import numpy as np

from tessera.llm import media

IMAGE = "image long, height int, width int, pixels binary"


def test_edited_copies_and_strangers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        m = media.mosaic(rng.normal(0, 0.125, 64))
        rows.append((10 * i, *m.shape, m.tobytes()))
        if i % 3 == 0:
            rows.append((10 * i + 1, *m.shape, m.tobytes()))
        if i % 3 == 1:
            e = np.ascontiguousarray(np.rot90(np.rint(m[4:, 2:-6] * 0.85 + 10).astype(np.uint8), i % 4))
            rows.append((10 * i + 2, *e.shape, e.tobytes()))
    rows += [(9001, 5, 5, b"x" * 25), (9002, 64, 64, bytes(64 * 64)), (9003, 3, 3, b"short"), (9004, None, None, None), (9005, None, None, None)]
    got = {r["image"]: (r["class_id"], r["copy_of"]) for r in media.image_copies(spark.createDataFrame(rows, IMAGE).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k in got:
        assert got[k][0] == (k // 10 * 10 if k < 9000 else k)
    assert all(got[10 * i + 1][1] == 10 * i for i in range(0, 30, 3))
    assert media.image_copies(spark.createDataFrame([], IMAGE)).count() == 0


def test_vectors_of_odd_shape_give_no_pixels(spark):
    df = spark.createDataFrame([(0, None, 1), (1, [0.5] * 3, 1), (2, [0.1] * 63 + [None], 1), (3, [0.1] * 64, 1), (None, [0.1] * 64, 1)], "vec_id long, embedding array<float>, label int")
    got = {r["image"]: r["pixels"] is not None for r in media.vector_images(df).collect()}
    assert got == {0: False, 2: False, 4: False, 6: True}


def test_turns_agree_across_any_border_of_the_grid(spark):
    point = "struct<y int, x int, direction int, scale int>"
    rows = []
    for i, turns in enumerate([(1, 2), (0, 23), (2, 3), (4, 6)]):
        rows += [(10 * i, 10 * i + 1, (k % 2, k // 2, 20, 1), (k % 2 + 30, k // 2 + 30, (20 + turns[k % 2]) % 24, 1)) for k in range(6)]
    got = media.linked(spark.createDataFrame(rows, f"i long, j long, p {point}, q {point}")).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(0, 1), (10, 11), (20, 21)]


def agreeing(candidates):
    """(i, j) to the corners that agree on one movement, by plain loops over pairs of descriptors."""
    votes = defaultdict(set)
    for one, two in candidates:
        (i, p, v), (j, q, w) = (one, two) if one[0] < two[0] else (two, one)
        if i == j or sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(v, w, strict=True)) > media.MAX_BITS:
            continue
        turn, ratio = (q[2] - p[2]) % media.DIRECTIONS, q[3] / p[3]
        angle = turn * 2 * np.pi / media.DIRECTIONS
        dy, dx = q[0] - ratio * (np.cos(angle) * p[0] + np.sin(angle) * p[1]), q[1] - ratio * (np.cos(angle) * p[1] - np.sin(angle) * p[0])
        for k in range(8):
            cell = ((turn + k // 4) % media.DIRECTIONS // 2, np.floor(dy / (2 * media.GRAIN) + 0.5 * (k % 2)), np.floor(dx / (2 * media.GRAIN) + 0.5 * (k // 2 % 2)))
            votes[i, j, np.floor(np.log2(ratio)), k, *cell].add(p)
    most = defaultdict(int)
    for v, ps in votes.items():
        most[v[:2]] = max(most[v[:2]], len(ps))
    return most


def brute_links(images, candidates):
    """Links by plain loops over the descriptors that the operator makes, seeds from neighbours in buckets or from all pairs."""
    points = []
    for k, m in images.items():
        _, y, x, d, s, bits = media.describe_stack(m[None])
        points += [(k, (int(b), int(a), int(e), int(g)), tuple(int(v) for v in w)) for b, a, e, g, w in zip(y, x, d, s, bits, strict=True)]
    corners = {k: sum(p[0] == k for p in points) for k in images}
    seeds = {pair for pair, n in agreeing(candidates(points)).items() if n >= media.SEED}
    whole = agreeing((one, two) for one, two in all_pairs(points) if (min(one[0], two[0]), max(one[0], two[0])) in seeds)
    return {(i, j) for (i, j), n in whole.items() if n >= media.MIN_AGREE and n >= media.MIN_SHARE * min(corners[i], corners[j])}


def neighbours(points):
    """Each entry of a table with the NEIGHBOURS before it in its bucket."""
    for t in range(media.TABLES):
        buckets = defaultdict(list)
        for point in points:
            buckets[(point[2][t] >> (32 * (t % 2))) & 0xFFFFFFFF].append(point)
        for entries in buckets.values():
            entries.sort(key=lambda e: (e[2], e[0], e[1]))
            for n, one in enumerate(entries):
                yield from ((one, two) for two in entries[max(0, n - media.NEIGHBOURS) : n])


def all_pairs(points):
    return ((one, two) for n, one in enumerate(points) for two in points[:n])


def test_links_against_plain_loops_and_recall_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    images, rows = {}, []
    for i in range(12):
        m = media.mosaic(rng.normal(0, 0.125, 64))
        images[10 * i], images[10 * i + 1] = m, np.rint(m[3:-2, 2:-3] * 0.9 + 8).astype(np.uint8)
        images[10 * i + 2] = np.clip(m + rng.normal(0, 4, m.shape), 0, 255).astype(np.uint8)
    rows = [(k, *m.shape, np.ascontiguousarray(m).tobytes()) for k, m in images.items()]
    got = {r["image"]: (r["class_id"], r["n_links"]) for r in media.image_copies(spark.createDataFrame(rows, IMAGE).repartition(3)).collect()}
    links, whole = brute_links(images, neighbours), brute_links(images, all_pairs)
    assert {k: n for k, (_, n) in got.items()} == {k: sum(k in pair for pair in links) for k in images}
    assert all(got[i][0] == got[j][0] for i, j in links)
    # cut copies with less contrast and noisy ones are all found; no stranger is linked
    assert all((10 * i, 10 * i + k) in links for i in range(12) for k in (1, 2))
    assert all(i // 10 == j // 10 for i, j in whole) and links <= whole


def test_links_that_the_tables_miss_are_found(spark):
    rng = np.random.default_rng(4)
    images = {}
    for i in range(14):
        m = media.mosaic(rng.normal(0, 0.125, 64))
        images[10 * i] = m
        images[10 * i + 1] = np.clip(m + rng.normal(0, 14, m.shape), 0, 255).astype(np.uint8)
        images[10 * i + 2] = np.clip(m[:, :40] + rng.normal(0, 12, (64, 40)), 0, 255).astype(np.uint8)
    tables, whole = brute_links(images, neighbours), brute_links(images, all_pairs)
    assert tables < whole
    rows = [(k, *m.shape, np.ascontiguousarray(m).tobytes()) for k, m in images.items()]
    got = {r["image"]: (r["class_id"], r["n_links"]) for r in media.image_copies(spark.createDataFrame(rows, IMAGE).repartition(3)).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: sum(k in pair for pair in whole) for k in images}
    assert all(got[i][0] == got[j][0] for i, j in whole)


def test_all_images_meet_in_panels_and_tiles_of_any_size(monkeypatch):
    rng = np.random.default_rng(6)
    m = [media.mosaic(rng.normal(0, 0.125, 64)) for _ in range(8)]
    images = {10 * i + k: np.clip(x + rng.normal(0, 4 * k, x.shape), 0, 255).astype(np.uint8) for i, x in enumerate(m) for k in range(3)}
    found = [(k, media.describe_stack(x[None])) for k, x in images.items()]
    size = np.array([len(p[0]) for _, p in found])
    turns, scales, bits = (np.concatenate([p[c] for _, p in found]) for c in (3, 4, 5))
    side = (np.array([k for k, _ in found]), np.concatenate([[0], size.cumsum()]), turns, scales, bits)
    links = brute_links(images, all_pairs)
    got = []
    for panel, tile in ((7, 5), (50, 64), (4096, 4096)):
        monkeypatch.setattr(media, "PANEL", panel)
        monkeypatch.setattr(media, "TILE", tile)
        pairs = [(int(i), int(j)) for some in media.close(side, side) for i, j in zip(*some, strict=True)]
        assert len(pairs) == len(set(pairs)) and links <= set(pairs)
        got.append(sorted(pairs))
    assert len(links) >= 16 and got[0] == got[1] == got[2]


def test_three_descriptors_meet_in_one_product_without_rounding():
    rng = np.random.default_rng(9)
    some = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    some[:3] = [[0] * 32, [255] * 32, [170] * 32]
    some[3:6] = ~some[:3]
    # copies that differ in as many of the first 255 bits as a match may, in one more, and in the last bit too
    for k, n in ((10, media.MAX_BITS), (11, media.MAX_BITS + 1), (12, media.MAX_BITS)):
        flipped = np.unpackbits(some[20])
        flipped[rng.choice(255, n, replace=False)] ^= 1
        flipped[255] ^= k == 12
        some[k] = np.packbits(flipped)
    bits = some.view(np.int64)
    ones = np.unpackbits(some, axis=1)[:, :255].astype(int)
    differ = (ones[:, None] != ones).sum(axis=2)
    for n in (1, 2, 3, 5, 6, 40):
        triples = media._triples(bits[:n])
        assert triples.shape == (256, -(-n // 6) * 2)
        packed = (media._signs(bits) @ triples).astype(np.int64)
        assert all((255 - (packed[:, k // 3] >> (8 * (k % 3)) & 255) == differ[:, k]).all() for k in range(n))
        near = media._near(media._signs(bits), triples)
        columns = [k // 3 * 4 + k % 3 for k in range(n)]
        assert (near[:, columns] == (differ[:, :n] <= media.MAX_BITS)).all()
        assert not np.delete(near, columns, axis=1).any()


def test_pairs_of_images_are_found_however_many_are_told_at_once(monkeypatch):
    rng = np.random.default_rng(10)
    sizes = np.array([4, 9, 30, 1, 5, 4, 4, 12])
    at = np.concatenate([[0], sizes.cumsum()])
    bits = np.repeat(rng.integers(0, 256, (1, 32), dtype=np.uint8), at[-1], axis=0)
    bits[at[2] : at[3] : 2] ^= 255
    # one bit more than a match may have, the last: only all 256 tell
    bits[at[5] : at[6], : media.MAX_BITS // 8] ^= 255
    bits[at[5] : at[6], 31] ^= 1
    side = (np.arange(len(sizes)), at, np.zeros(at[-1], dtype=np.int64), np.ones(at[-1], dtype=np.int64), bits.view(np.int64))
    same = lambda p, q: np.bitwise_count(bits[p] ^ bits[q]).sum() <= media.MAX_BITS
    spans = [range(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    want = {(i, j) for j, js in enumerate(spans) for i, ps in enumerate(spans[:j]) if sum(any(same(p, q) for q in js) for p in ps) >= max(media.MIN_AGREE, media.MIN_SHARE * min(len(ps), len(js)))}
    for panel, told in ((1536, 4096), (7, 1), (3, 5)):
        monkeypatch.setattr(media, "PANEL", panel)
        monkeypatch.setattr(media, "TURNED", told)
        got = [(int(i), int(j)) for some in media.close(side, side) for i, j in zip(*some, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and 10 < len(want) < 28
