"""Plans of the corpus packer."""
