"""DataFrame operators: tables of points, frames, outlines, nodes and pixels in, tables out."""
