"""Table functions for SQL users: neighbourhoods, event windows and covariance bands as joins that SQL can write."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    """band_offsets(n INT COMMENT 'pixels to each side, the pixel itself included') RETURNS TABLE (dcol INT, drow INT)
    RETURN SELECT dcol, drow FROM (SELECT explode(sequence(0, n - 1)) AS dcol) LATERAL VIEW explode(sequence(1 - n, n - 1)) AS drow
    WHERE dcol > 0 OR drow >= 0""",
    """neighbour_pixels(px INT, reach INT, height INT, width INT) RETURNS TABLE (neighbour INT)
    RETURN SELECT neighbour_pixels.px + r + c * neighbour_pixels.height
    FROM (SELECT explode(sequence(-neighbour_pixels.reach, neighbour_pixels.reach)) AS r) LATERAL VIEW explode(sequence(-neighbour_pixels.reach, neighbour_pixels.reach)) AS c
    WHERE neighbour_pixels.px % neighbour_pixels.height + r BETWEEN 0 AND neighbour_pixels.height - 1
      AND neighbour_pixels.px DIV neighbour_pixels.height + c BETWEEN 0 AND neighbour_pixels.width - 1""",
    """event_window(key_frame BIGINT, first INT, last INT) RETURNS TABLE (lag INT, frame BIGINT)
    RETURN SELECT o, event_window.key_frame + o FROM (SELECT explode(sequence(event_window.first, event_window.last)) AS o)""",
)


def register_table_functions(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
