"""From an image and a trimap to a cutout: one pair of files, or all pairs of two folders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.plans import images
from alphaloom.plans.estimators import estimate_alpha_cf, estimate_foreground_ml
from alphaloom.sources.images import load_image, load_images, save_image, save_images

RGB = ["r", "g", "b"]


def cutout(image_path: str, trimap_path: str, cutout_path: str) -> None:
    """ValueError if image and trimap differ in size."""
    image, trimap = load_image(image_path, "RGB"), load_image(trimap_path, "GRAY")
    if image.shape[:2] != trimap.shape:
        raise ValueError("the image and its trimap differ in size")
    alpha = estimate_alpha_cf(image, trimap)
    save_image(cutout_path, np.concatenate((estimate_foreground_ml(image, alpha), alpha[..., None]), axis=2))


def matted(pixels: DataFrame, method: str = "cf", size: images.Size = None, **options) -> DataFrame:
    """Foreground r, g, b and alpha a of images with a trimap (image_id, y, x, r, g, b, t)."""
    alpha = images.estimate_alpha(pixels, method, size, **options)
    fg = images.estimate_foreground(pixels.select("image_id", "y", "x", *RGB).join(alpha, ["image_id", "y", "x"]), "ml", size)
    return fg.join(alpha, ["image_id", "y", "x"]).select("image_id", "y", "x", *(F.col(f"f_{c}").alias(c) for c in RGB), F.col("alpha").alias("a"))


def cutout_folder(spark: SparkSession, image_glob: str, trimap_glob: str, folder: str, method: str = "cf", **options) -> None:
    """Images and trimaps meet by file name; a file per image_id, a hash of the name, is written. Each image is one task's work."""
    name = F.xxhash64(F.element_at(F.split("path", "/"), -1))
    image = load_images(spark, image_glob, "RGB").withColumn("image_id", name)
    trimap = load_images(spark, trimap_glob, "GRAY").select(name.alias("image_id"), "y", "x", F.col("v").alias("t"))
    save_images(matted(image.select("image_id", "y", "x", *RGB).join(trimap, ["image_id", "y", "x"]), method, **options), [*RGB, "a"], folder)
