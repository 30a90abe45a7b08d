"""Lossless JPEG (process 14, any predictor) as files of medical images hold it, frame by frame inside tasks."""

from __future__ import annotations

import struct


def lossless(data: bytes):
    """The samples of a lossless JPEG image, as an array by row, column and component."""
    import numpy as np

    at, tables, restart, frame, scan = 2, {}, 0, None, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while scan is None:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("JPEG marker expected")
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xC4:
            tables |= _huffman(body)
        elif mark == 0xC3:
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k]) for k in range(n)]
            if n > 1 and any(p[1] != 0x11 for p in parts):
                raise ValueError("JPEG components of different size cannot be read")
            frame = (bits, h, w, n)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("only lossless JPEG with Huffman codes can be read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            n = body[0]
            codes = [tables[body[2 + 2 * k] >> 4] for k in range(n)]
            scan = (codes, body[1 + 2 * n], body[3 + 2 * n] & 15)
        at += 2 + size
    bits, h, w, n = frame
    codes, predictor, shift = scan
    if len(codes) != n or not 1 <= predictor <= 7:
        raise ValueError("JPEG scans of some components, or without a predictor, cannot be read")
    diffs = _differences(data, at, codes, h * w * n, restart * n)
    out = np.stack([_predicted(diffs[k::n].reshape(h, w), predictor, 1 << (bits - shift - 1), restart) for k in range(n)], axis=2)
    return out << shift


def _huffman(body: bytes) -> dict[int, list[tuple[int, int]]]:
    """Tables by number: for each next 16 bits the length of the code that they begin with, and what it stands for."""
    out, at = {}, 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        values, code, table = iter(body[at + 17 : at + 17 + sum(counts)]), 0, [(0, 0)] * 65536
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[code << (16 - length) : (code + 1) << (16 - length)] = [(length, next(values))] * (1 << (16 - length))
                code += 1
            code <<= 1
        out[body[at] & 15] = table
        at += 17 + sum(counts)
    return out


def _differences(data: bytes, at: int, codes: list, total: int, restart: int):
    """The coded differences, component by component of each pixel."""
    import numpy as np

    out, n = np.zeros(total, np.int64), len(codes)
    held, have = 0, 0  # bits read ahead
    for i in range(total):
        if restart and i and i % restart == 0:
            held = have = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
        while have < 40:
            byte = data[at] if at < len(data) else 0
            if byte == 0xFF and at + 1 < len(data) and data[at + 1]:
                byte = 0  # a marker: the scan ends, or restarts, with what is held
            else:
                at += 2 if byte == 0xFF else 1
            held, have = held << 8 | byte, have + 8
        length, size = codes[i % n][held >> (have - 16) & 0xFFFF]
        if not length:
            raise ValueError("JPEG code unknown")
        have -= length
        if size == 16:
            out[i] = 32768
        elif size:
            have -= size
            bits = held >> have & ((1 << size) - 1)
            out[i] = bits if bits >> (size - 1) else bits - (1 << size) + 1
        held &= (1 << have) - 1
    return out


def _predicted(diff, predictor: int, middle: int, restart: int):
    """Samples from differences; the first line of the image, and of each restart, goes by its left neighbours alone."""
    import numpy as np

    h, w = diff.shape
    if restart and restart % w:
        raise ValueError("JPEG restarts inside a line cannot be read")
    lines, out = (restart // w if restart else h), np.zeros((h, w), np.int64)
    for y in range(h):
        if y % lines == 0:
            out[y] = (middle + diff[y].cumsum()) & 0xFFFF
        elif predictor == 1:
            out[y] = (out[y - 1, 0] + diff[y].cumsum()) & 0xFFFF
        elif predictor == 2:
            out[y] = (out[y - 1] + diff[y]) & 0xFFFF
        else:
            above, row = out[y - 1].tolist(), diff[y].tolist()
            left = now = (above[0] + row[0]) & 0xFFFF
            got = [now]
            for x in range(1, w):
                b, c = above[x], above[x - 1]
                p = (c, left + b - c, left + ((b - c) >> 1), b + ((left - c) >> 1), (left + b) >> 1)[predictor - 3]
                left = (p + row[x]) & 0xFFFF
                got.append(left)
            out[y] = got
    return out
