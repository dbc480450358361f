"""Command lines for cutting, joining and scaling media files."""

from __future__ import annotations

import argparse
import os
import re
import subprocess
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidMedia
from ..functions.timeline import BEGIN, END, FPS, select_expression, time_expression


@dataclass(frozen=True)
class FilterSpec:
    """A filter and its options, in order."""

    name: str
    options: list[tuple[str, object]] = field(default_factory=list)

    def with_option(self, key: str, value: object) -> FilterSpec:
        return replace(self, options=[*((k, v) for k, v in self.options if k != key), (key, value)])

    def without_option(self, key: str) -> FilterSpec:
        return replace(self, options=[(k, v) for k, v in self.options if k != key])

    def build(self) -> str:
        return self.name + ("=" + ":".join(f"{k}={v}" for k, v in self.options) if self.options else "")

    def as_column(self) -> Column:
        """The same for every row, where options may be columns."""
        parts = [F.concat(F.lit(f"{k}="), (v if isinstance(v, Column) else F.lit(v)).cast("string")) for k, v in self.options]
        return F.concat(F.lit(f"{self.name}="), F.concat_ws(":", *parts)) if parts else F.lit(self.name)


@dataclass(frozen=True)
class MediaCommand:
    """An immutable command; every setter returns a new one. build() gives the arguments in their fixed order."""

    binary: str = "ffmpeg"
    inputs: tuple[str, ...] = ()
    target: str = "-"
    values: tuple[tuple[str, str], ...] = ()
    video_filters: tuple[FilterSpec, ...] = ()
    audio_filters: tuple[FilterSpec, ...] = ()

    def input(self, path: str) -> MediaCommand:
        return replace(self, inputs=(*self.inputs, path))

    def output(self, path: str) -> MediaCommand:
        return replace(self, target=path)

    def video_filter(self, spec: FilterSpec) -> MediaCommand:
        return replace(self, video_filters=(*self.video_filters, spec))

    def audio_filter(self, spec: FilterSpec) -> MediaCommand:
        return replace(self, audio_filters=(*self.audio_filters, spec))

    def _set(self, key: str, value: object) -> MediaCommand:
        return replace(self, values=(*((k, v) for k, v in self.values if k != key), (key, str(value))))

    def hardware(self, kind: str) -> MediaCommand:
        return self._set("hwaccel", kind)

    def safe(self, level: int) -> MediaCommand:
        return self._set("safe", level)

    def seek(self, seconds: float) -> MediaCommand:
        """Start reading the input there."""
        return self._set("ss", repr(seconds))

    def input_format(self, name: str) -> MediaCommand:
        return self._set("f_in", name)

    def output_format(self, name: str) -> MediaCommand:
        return self._set("f_out", name)

    def decoder(self, name: str) -> MediaCommand:
        return self._set("c:v", name)

    def audio_decoder(self, name: str) -> MediaCommand:
        return self._set("c:a", name)

    def encoder(self, name: str) -> MediaCommand:
        return self._set("vcodec", name)

    def audio_encoder(self, name: str) -> MediaCommand:
        return self._set("acodec", name)

    def pixel_format(self, name: str) -> MediaCommand:
        return self._set("pix_fmt", name)

    def no_video(self) -> MediaCommand:
        return self._set("vn", "")

    def no_audio(self) -> MediaCommand:
        return self._set("an", "")

    def build(self) -> list[str]:
        have = dict(self.values)

        def option(key: str, flag: str | None = None) -> list[str]:
            return [f"-{flag or key}", have[key]] if key in have else []

        def filters(flag: str, specs: tuple[FilterSpec, ...]) -> list[str]:
            return [flag, ",".join(s.build() for s in specs)] if specs else []

        before = ["-y", "-hide_banner", *option("hwaccel"), *option("safe"), *option("f_in", "f"), *option("ss")]
        sources = [x for path in self.inputs for x in ("-i", path)]
        after = [*option("c:v"), *option("c:a"), *filters("-vf", self.video_filters), *filters("-af", self.audio_filters), *option("vcodec"), *option("acodec"), *option("pix_fmt")]
        muted = [flag for flag in ("-vn", "-an") if flag[1:] in have]
        return [self.binary, *before, *sources, *after, *muted, *option("f_out", "f"), self.target]

    def run(self) -> subprocess.Popen:
        return subprocess.Popen(self.build(), stdout=subprocess.PIPE, stderr=subprocess.PIPE)


def frame_rate(entry: str | None) -> tuple[int, int]:
    """(num, den) of a rate written num/den; other rates are no valid media."""
    found = re.fullmatch(r"(\d+)/(\d+)", entry or "")
    if not found or not int(found[1]) or not int(found[2]):
        raise InvalidMedia(f"frame rate {entry!r}")
    return int(found[1]), int(found[2])


def cut_command(source: str, target: str, start: int | str = BEGIN, stop: int | str = END, rate: tuple[int, int] | None = None, decoder: str | None = None, encoder: str | None = None) -> MediaCommand:
    """Frames start..stop of a file, both included, picture and sound, times counted from the cut.

    rate: the file's frames per second as (num, den), which the sound's times need unless the whole file is taken."""
    if rate is None and (start, stop) != (BEGIN, END):
        raise ValueError("the file's frame rate is needed to cut its sound")
    command = MediaCommand().input(source).output(target)
    command = command.video_filter(FilterSpec("select", [("e", f"'{select_expression(start, stop)}'")])).video_filter(FilterSpec("setpts", [("expr", "PTS-STARTPTS")]))
    command = command.audio_filter(FilterSpec("aselect", [("e", f"'{time_expression(start, stop, rate or (FPS, 1))}'")])).audio_filter(FilterSpec("asetpts", [("expr", "N/SR/TB")]))
    command = command.decoder(decoder) if decoder else command
    return command.encoder(encoder) if encoder else command


def list_line(path: Column) -> Column:
    """A line of the list file, of a column of paths."""
    return F.format_string("file '%s'\n", path)


def concat_list(paths: list[str]) -> str:
    """The list file that the concat reader takes."""
    return "".join(f"file '{os.path.abspath(p)}'\n" for p in paths)


def cat_command(list_file: str, target: str) -> MediaCommand:
    return MediaCommand().safe(0).input_format("concat").input(list_file).encoder("copy").audio_encoder("copy").output(target)


#: What force_original_aspect_ratio takes.
ASPECTS = ("disable", "decrease", "increase")


def scale_command(source: str, target: str, height: int | str = 0, width: int | str = 0, decoder: str | None = None, encoder: str | None = None, aspect: str = "disable") -> MediaCommand:
    """Scaled to height and width; 0 keeps the input's, and aspect says what gives way to keep its proportion."""
    if aspect not in ASPECTS:
        raise ValueError(f"aspect must be one of {ASPECTS}")
    spec = FilterSpec("scale", [("height", height), ("width", width), ("force_original_aspect_ratio", aspect)])
    command = MediaCommand().input(os.path.abspath(source)).video_filter(spec).output(os.path.abspath(target))
    command = command.decoder(decoder) if decoder else command
    return command.encoder(encoder) if encoder else command


def first_difference(probes: list[dict]) -> str | None:
    """In what (scale, vcodec, acodec) any of the inputs' probes differs from the first."""

    def entries(found: dict) -> dict[str, object]:
        first = {kind: next((x for x in found.get("streams", []) if x.get("codec_type") == kind), {}) for kind in ("video", "audio")}
        return {"vcodec": first["video"].get("codec_name"), "acodec": first["audio"].get("codec_name"), "scale": (first["video"].get("width"), first["video"].get("height"))}

    want = entries(probes[0])
    return next((name for p in probes for name, value in entries(p).items() if value != want[name]), None)


def parser(base: argparse.ArgumentParser | None = None) -> argparse.ArgumentParser:
    """cut, cat and scale as sub-commands; base: a parser to add them to."""
    base = base or argparse.ArgumentParser(prog="framewright")
    base.add_argument("--dry-run", action="store_true", help="print the command only")
    sub = base.add_subparsers(dest="command", required=True)
    cut = sub.add_parser("cut")
    cut.add_argument("--start", default=BEGIN)
    cut.add_argument("--stop", default=END)
    scale = sub.add_parser("scale")
    scale.add_argument("--width", default="0")
    scale.add_argument("--height", default="0")
    scale.add_argument("--aspect", default="disable", choices=ASPECTS)
    cat = sub.add_parser("cat")
    for p in (cut, scale):
        p.add_argument("--decoder")
        p.add_argument("--encoder")
        p.add_argument("source")
    cat.add_argument("sources", nargs="+")
    for p in (cut, scale, cat):
        p.add_argument("target")
    return base


def main(argv: list[str] | None = None, probe: Callable[[str], dict] | None = None) -> int:
    """Exit code of the command; -1 where the inputs of cat are too few or differ. probe: what the probe tool says of a file."""
    args = parser().parse_args(argv)
    if probe is None:
        from ..sources.media import probe
    listed = None
    if args.command == "cat":
        if len(args.sources) < 2:
            return -1
        for p in args.sources:
            if not os.path.exists(p):
                raise FileNotFoundError(p)
        if differs := first_difference([probe(p) for p in args.sources]):
            print(f"inputs differ in {differs}", file=sys.stderr)
            return -1
        with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False) as f:
            f.write(concat_list(args.sources))
        listed = f.name
        command = cat_command(listed, args.target)
    elif args.command == "cut":
        video = next((x for x in probe(args.source).get("streams", []) if x.get("codec_type") == "video"), {})
        command = cut_command(args.source, args.target, args.start, args.stop, frame_rate(video.get("r_frame_rate")), args.decoder, args.encoder)
    else:
        command = scale_command(args.source, args.target, args.height, args.width, args.decoder, args.encoder, args.aspect)
    try:
        if args.dry_run:
            print(" ".join(command.build()))
            return 0
        run = command.run()
        run.communicate()
        return run.returncode
    finally:
        if listed:
            os.unlink(listed)


if __name__ == "__main__":
    sys.exit(main())
