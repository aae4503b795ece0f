"""Operators of the corpus packer."""
