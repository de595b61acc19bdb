"""Planar geometry in pure Python: encodings, measures, relations and overlays.

A geometry is a pair (kind, data): Point has a coordinate pair or None, LineString and
MultiPoint a list of pairs, Polygon a list of closed rings, and the other Multi kinds and
GeometryCollection lists of the like.
"""
