"""A GIF that another encoder made, against its picture as drawn."""

from tessera.llm import gif_media

#: The ten by ten sample picture of a public description of the format.
SAMPLE = """
47 49 46 38 39 61 0A 00 0A 00 91 00 00 FF FF FF FF 00 00 00 00 FF 00 00 00 21 F9 04 00 00 00 00 00 2C 00 00 00 00 0A 00 0A 00 00
02 16 8C 2D 99 87 2A 1C DC 33 A0 02 75 EC 95 FA A8 DE 60 8C 04 91 4C 01 00 3B
"""
PICTURE = ["rrrrrbbbbb"] * 3 + ["rrrwwwwbbb"] * 2 + ["bbbwwwwrrr"] * 2 + ["bbbbbrrrrr"] * 3
COLOURS = {"r": (255, 0, 0, 255), "b": (0, 0, 255, 255), "w": (255, 255, 255, 255)}


def test_picture_of_another_encoder():
    frames = list(gif_media.decode_gif(bytes.fromhex("".join(SAMPLE.split()))))
    assert len(frames) == 1
    shown = [tuple(p) for p in frames[0].canvas.reshape(-1, 4).tolist()]
    assert shown == [COLOURS[c] for row in PICTURE for c in row]
