"""``python -m lanternfish setup | build-db | caption --image FILE [--skip-crops]``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from lanternfish.pipeline import Pipeline, Settings


def named(name: str | None) -> Callable | None:
    """The object of ``module:name``."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternfish")
    p.add_argument("--backend", choices=["retrieval", "blip"], default="retrieval")
    p.add_argument("--images", "--coco-img-dir", default=Settings.images, help="folder of images named by number")
    p.add_argument("--annotations", "--coco-ann-file", default=Settings.annotations, help="annotation file")
    p.add_argument("--index", "--chroma-db-dir", default=Settings.index, help="folder of the caption index")
    p.add_argument("--encoder", help="module:function that loads the image model")
    p.add_argument("--crops", help="module:function that makes variants of images")
    p.add_argument("--generator", help="module:udf that writes captions, for the blip backend")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("setup", help="open the index, or make an empty one")
    commands.add_parser("build-db", help="build the index from annotated images")
    caption = commands.add_parser("caption", help="caption one image")
    caption.add_argument("--image", required=True)
    caption.add_argument("--skip-crops", "--skip-detr", action="store_true", help="ask with the whole image only")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lanternfish").getOrCreate()
    settings = Settings(images=args.images, annotations=args.annotations, index=args.index, backend=args.backend)
    pipeline = Pipeline(spark, settings, named(args.encoder), named(args.crops), named(args.generator))
    if args.command == "setup":
        print(f"Index rows: {pipeline.setup().first()['total_embeddings']}")
    elif args.command == "build-db":
        if not pipeline.build_index():
            print("images or annotations not found", file=sys.stderr)
            return 1
    else:
        got = pipeline.caption_image(args.image, advanced=not args.skip_crops)
        print(f"Backend: {got['backend']}\nCaption: {got['generated_caption']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
